"""Salvage against the rule itself: the longest prefix that parses after ``]}`` is appended."""

import json
import random

from suiteforge.functions import salvage as sv


def by_hand(text):
    try:
        found = json.loads(text)
    except ValueError:
        for n in range(len(text), -1, -1):
            try:
                found = json.loads(text[:n] + "]}")
                break
            except ValueError:
                continue
        else:
            return "null", None
    if not isinstance(found, dict):
        return sv.ERROR_QUESTION, sv.ERROR_TESTS
    q = found.get("question", sv.ERROR_QUESTION)
    tests = found.get("tests", sv.ERROR_TESTS)
    if isinstance(tests, list):
        tests = [t if t is None or isinstance(t, str) else json.dumps(t, separators=(",", ":")) for t in tests]
    else:
        tests = None
    return q if isinstance(q, str) else json.dumps(q, separators=(",", ":")), tests


def some_value(draw, depth=0):
    kind = draw.randrange(8 if depth < 2 else 6)
    if kind < 3:
        return json.dumps("".join(draw.choice('ab"\\\n{}[],: é') for _ in range(draw.randrange(8))), ensure_ascii=draw.random() < 0.5)
    if kind < 6:
        return draw.choice(["12", "-3", "0", "true", "false", "null"])
    inner = [some_value(draw, depth + 1) for _ in range(draw.randrange(3))]
    return "[" + ", ".join(inner) + "]" if kind == 6 else "{" + ", ".join(f'"k{i}": {v}' for i, v in enumerate(inner)) + "}"


def some_text(draw):
    members = [f'"question": {draw.choice([some_value(draw, 2), json.dumps("what?")])}', '"tests": [' + ", ".join(some_value(draw, 2) for _ in range(draw.randrange(5))) + "]"]
    members += [f'"m{i}": {some_value(draw)}' for i in range(draw.randrange(3))]
    if draw.random() < 0.3:
        members.append(draw.choice(members))  # a repeated key
    draw.shuffle(members)
    text = "{" + draw.choice([", ", ",", ",\n  "]).join(members) + "}"
    if draw.random() < 0.7:
        text = text[: draw.randrange(len(text) + 1)]
    if draw.random() < 0.3 and text:
        at = draw.randrange(len(text))
        text = text[:at] + draw.choice(["x", ",", '"', "]", "}", "", "1"]) + text[at + 1 :]
    return text.strip()


def test_salvage_follows_the_rule_on_random_texts(spark):
    draw = random.Random(5)
    texts = sorted({some_text(draw) for _ in range(700)})
    got = {r.r: (r.problem, r.tests) for r in sv.parse_responses(spark.createDataFrame([(t,) for t in texts], "r string"), "r").collect()}
    wrong = {t: (got[t], by_hand(t)) for t in texts if got[t] != by_hand(t)}
    assert not wrong, list(wrong.items())[:5]


def test_salvage_of_very_long_texts(spark):
    body = "x" * 400_000
    tests = [json.dumps(f"assert {i}") for i in range(3000)]
    text = '{"question": "' + body + '", "tests": [' + ", ".join(tests) + ', "cut'
    row = sv.parse_responses(spark.createDataFrame([(text,)], "r string"), "r").first()
    assert row.problem == body and row.tests == [json.loads(t) for t in tests]
