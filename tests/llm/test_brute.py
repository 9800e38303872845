"""The operators against brute force, exact libraries, schedules' bounds and held-out labels."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from suiteforge.llm import decontam, gru_lm, langid, lz_fingerprint, neardup, pfair, prefix_tokens, quality, toxicity, warc
from suiteforge.llm.common import words
from suiteforge.llm.queries import ORACLE, QUERIES, vocabulary_path

from .conftest import SF_MID, SF_SMALL, prose


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}


def same_rows(df, duck, sql):
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(map(str, r)) for r in df.select(*names).collect()) == sorted(tuple(map(str, r)) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SF_SMALL), duck, ORACLE[name])


# op1


def test_warc_record_text(spark):
    rows = spark.createDataFrame([("<urn:uuid:1>", "http://a/", "2024-01-01T00:00:00Z", "HTTP/1.1 200 OK\r\nServer: x", "<p>Hé</p>")], "record_id string, target_uri string, warc_date string, http_head string, body string")
    for r in warc.record_text(warc.derivatives(rows)).collect():
        head, block = r.record.split("\r\n\r\n", 1)
        fields = dict(line.split(": ", 1) for line in head.split("\r\n")[1:])
        assert block == r.block + "\r\n\r\n" and int(fields["Content-Length"]) == len(r.block.encode())
        assert fields["WARC-Refers-To"] == "<urn:uuid:1>" and fields["WARC-Refers-To-Target-URI"] == "http://a/"
        assert fields["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(r.block.encode()).digest()).decode()
        if r.record_type == "metadata":
            assert "source-head: Server: x\r\n" in r.block and r.source_payload_digest in r.block
        else:
            assert r.block == "Hé"


# op2


def brute_windows(items, text):
    own, mask, found = words(text), set(), set()
    for item, phrase in items:
        w = words(phrase)
        for i in range(max(1, len(w) - 9) if w else 0):
            p = w[i : i + 10]
            for j in range(len(own) - len(p) + 1):
                if own[j : j + len(p)] == p:
                    mask.update(range(j, j + len(p)))
                    found.add(item)
    return len(mask), sorted(found)


def test_fm_index_on_random_texts():
    draw = random.Random(1)
    for _ in range(150):
        texts = [b" ".join(draw.choice([b"a", b"b", b"c", b"d"]) for _ in range(draw.randint(0, 30))) for _ in range(6)]
        items = [(str(i), b" ".join(draw.choice([b"a", b"b", b"c", b"e"]) for _ in range(draw.randint(0, 14)))) for i in range(3)]
        got = decontam.find_in([words(t) for t in texts], decontam.Phrases.of(items))
        assert [(sum(n for _, n in s), i) for s, i in got] == [brute_windows(items, t) for t in texts]


def test_short_shards_with_many_phrases():
    """A shard far smaller than the phrase vocabulary."""
    draw = random.Random(2)
    vocabulary = [f"w{i}".encode() for i in range(3000)]
    items = [(str(i), b" ".join(draw.choice(vocabulary) for _ in range(draw.randint(1, 30)))) for i in range(150)]
    phrases = decontam.Phrases.of([i for i in items if len(words(i[1])) >= 8])
    long = [i for i in items if len(words(i[1])) >= 8]
    for _, text in long[:60]:
        own = b"zz " + text + b" zz " + b" ".join(text.split()[:9])
        assert [(sum(n for _, n in s), i) for s, i in decontam.find_in([words(own)], phrases)] == [brute_windows(long, own)]


def test_remove_is_the_same_over_blocks(spark):
    w = [f"w{i}" for i in range(30)]
    # windows of items in different blocks overlap, and cutting one passage brings the ends of another together
    items = [(1, " ".join(w[:12])), (2, " ".join(w[8:22])), (3, "aa bb cc dd ee ff gg hh ii jj"), (4, "left right")]
    docs = [(1, "one " + " ".join(w) + " two", 0), (2, "x aa bb cc dd ee " + " ".join(w[:12]) + " ff gg hh ii jj y", 0), (3, "left " + " ".join(w[8:22]) + " right", 0), (4, "clean Text.", 0), (5, None, 0)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string, n_chars long")
    one, many = (sorted((r.doc_id, r.text, r.n_chars) for r in decontam.remove(table, bench, block_bytes=n).collect()) for n in (8 << 20, 40))
    assert one == many
    kept = {i: t for i, t, _ in one}
    assert kept[1].split() == ["one", *w[22:], "two"] and kept[2].split() == ["x", "y"] and 3 not in kept
    assert kept[4] == "clean Text." and kept[5] is None


def test_phrase_blocks_do_not_change_the_result(spark):
    docs, bench = spark.read.parquet(f"{SF_SMALL}/documents.parquet"), spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    one, many = (sorted(map(str, decontam.find(docs, bench, block_bytes=n).collect())) for n in (8 << 20, 1500))
    assert one == many and any("Row(start=" in r for r in one)


def test_removal_leaves_no_phrase(spark):
    docs, bench = spark.read.parquet(f"{SF_SMALL}/documents.parquet"), spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    clean = decontam.remove(docs, bench)
    assert clean.schema == docs.schema and decontam.find(clean, bench).where("size(spans) > 0").count() == 0
    before = {r.doc_id: r for r in docs.collect()}
    hit = {r.doc_id for r in decontam.find(docs, bench).where("size(spans) > 0").collect()}
    after = {r.doc_id: r for r in clean.collect()}
    assert hit and all(after[i] == r for i, r in before.items() if i not in hit)
    assert all(r.n_chars == len(r.text) for i, r in after.items() if i in hit)


# op3


def test_gru_gradients(monkeypatch):
    monkeypatch.setattr(gru_lm, "HIDDEN", 4)
    monkeypatch.setattr(gru_lm, "EMBED", 3)
    draw = np.random.default_rng(0)
    vector = draw.normal(0, 0.3, len(gru_lm.Gru(100).vector))
    units, target = draw.integers(0, 100, (5, 3)), draw.integers(-1, 100, (5, 3))
    keep = (draw.random((5, 3)) > 0.3).astype(float)

    def run(v):
        grads = gru_lm.Gru(100, np.zeros_like(v))
        return gru_lm.Gru(100, v).window(units, target, keep, np.zeros((3, 4)), grads)[0], grads.vector

    _, found = run(vector.copy())
    for i in draw.integers(0, len(vector), 40):
        up, down = vector.copy(), vector.copy()
        up[i] += 1e-3
        down[i] -= 1e-3
        assert abs((run(up)[0] - run(down)[0]) / 2e-3 - found[i]) < 1e-3


def test_gru_probabilities_add_up_and_windows_carry_state():
    units = gru_lm.Units.of([(f"w{i}", 50 - i) for i in range(40)], 10, np.full(gru_lm.BUCKETS, 2.0))
    model = gru_lm.Gru.start(units)
    model.vector += np.random.default_rng(1).normal(0, 0.1, len(model.vector)).astype(np.float32)
    state = np.random.default_rng(2).normal(0, 1, (1, gru_lm.HIDDEN)).astype(np.float32)
    every = np.arange(model.n_classes * gru_lm.CLASS_SIZE)
    logs, _ = model.log_likelihood(np.repeat(state, len(every), 0), every)
    assert abs(np.exp(logs).sum() - 1) < 1e-4
    texts = [np.random.default_rng(k).integers(0, 60, n).astype(np.int32) for k, n in enumerate((0, 1, 15, 16, 17, 100))]
    got = gru_lm.score_docs(model, texts, units.end, lanes=4)
    for text, total in zip(texts, got, strict=True):  # one step after the other, no windows
        h, want = np.zeros((1, gru_lm.HIDDEN), np.float32), 0.0
        for a, b in zip([units.end, *text], [*text, units.end], strict=True):
            h = model.step(model.inputs()[[a]], h)[0]
            want += float(model.log_likelihood(h, np.array([b]))[0][0])
        assert abs(total - want) < 1e-3 * max(1, abs(want))


def test_lm_base_and_held_out_gain(spark):
    rows = QUERIES["op3_lm_score"](spark, SF_MID).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    toks = {k: [*re.findall(r"[^\x20\x09-\x0D]+", t.translate(low)), None] for k, t in texts.items()}
    counts = Counter()
    for k, own in toks.items():
        if zlib.crc32(str(k).encode()) % 10:
            counts.update(own)
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        own = toks[r.doc_id]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), n)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0) and abs(base - r.base_score) < 1e-6 * max(1, abs(base))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)


def test_every_round_trains_on_every_training_document(spark, monkeypatch):
    docs = spark.createDataFrame([(i, prose(i, 5 + i % 7)) for i in range(300)], "doc_id long, text string").repartition(2)
    trained, average, fit = [], gru_lm.average, gru_lm.fit

    def seen(shards):
        trained.append(sum(r.weight for r in shards.where("chunk = 0").collect()))
        return average(shards)

    monkeypatch.setattr(gru_lm, "average", seen)
    monkeypatch.setattr(gru_lm, "fit", lambda docs, units, n, *args, **options: fit(docs, units, 200_000, *args, **options))  # the count of a large table
    gru_lm.score(docs, F.lit(True), shard_docs=50_000).collect()
    assert trained == [sum(5 + i % 7 + 1 for i in range(300))] * 3



# op4


def test_token_counts_are_the_librarys(spark, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path())
    for r in QUERIES["op4_token_counts"](spark, SF_SMALL).collect():
        assert r.n_tokens == len(library.encode(docs[r.doc_id])) and r.n_bytes == len(docs[r.doc_id].encode())
        assert r.over_limit == (r.n_tokens > 4096)


def test_every_prefix_is_the_librarys(spark):
    import sentencepiece

    library, vocab = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path()), prefix_tokens.vocabulary(vocabulary_path())
    parts = ["a", "the", " ", "  ", "\n", "\t", "é", "ing", "<s>", "▁", "　", "\U0001f600", "日本", "12", "###", "\r\n", "\r\r", "\x00", "​", "aaaa", "    "]
    draw = random.Random(3)
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 12))) for _ in range(150)] + ["", "x" * 200 + " y", prose(1, 60)]
    stored = prefix_tokens.token_counts(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string"), vocabulary_path(), 5, store_prefixes=True)
    for r in prefix_tokens.within_budget(stored.withColumnRenamed("n_chars_within", "walked"), 5).collect():
        text = texts[r.doc_id]
        want = [len(library.encode(text[:i])) for i in range(len(text) + 1)]
        assert r.prefix_tokens == want and r.n_chars_within == r.walked == max(i for i, n in enumerate(want) if n <= 5)
        assert prefix_tokens.count(text, vocab) == want[-1]


# op5


def test_fingerprints_against_plain_parse(spark, docs):
    rows = {r.doc_id: r for r in QUERIES["op5_lz_fingerprints"](spark, SF_SMALL).collect()}
    order, hashes = sorted(docs.items(), reverse=True), lz_fingerprint.UnitHashes()

    def phrases(text):
        seen, phrase = set(), ()
        for unit in lz_fingerprint.units(text):
            phrase += (unit,)
            if phrase not in seen:
                seen.add(phrase)
                phrase = ()
        return seen

    for i, (key, text) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        k = len(text) // 3
        edited = text[: len(text) - k] + following[:k]
        r = rows[key]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(text)
        own = lz_fingerprint.fingerprint(text, hashes)
        assert r.fingerprint == lz_fingerprint.text_of(own) and r.edited_fingerprint == lz_fingerprint.text_of(lz_fingerprint.fingerprint(edited, hashes))
        a, b = phrases(text), phrases(edited)
        assert abs(r.near_edited - len(a & b) / len(a | b)) < 0.2
        assert r.near_next == lz_fingerprint.likeness(own, lz_fingerprint.fingerprint(following, hashes))


# op6


def lags_stay_below_one_block(plan, target):
    """Windows and lag against the exact target weights, over 1,000 periods (each has the same slots)."""
    total = sum(target.values())
    assert {r.key: r.parts for r in plan} == target and {r.period for r in plan} == {total}
    assert sorted(t for r in plan for t in r.slots) == list(range(total))
    for r in plan:
        for q in (0, 1, 7, 999):
            for j, t in enumerate(r.slots, q * r.parts + 1):
                assert (j - 1) * total // r.parts <= q * total + t < -(-j * total // r.parts)
        slots = np.array(r.slots) + total * np.arange(1000)[:, None]
        slots, given = slots.ravel(), np.arange(1, slots.size + 1)
        # the lag is largest just before and just after a block
        assert (slots * r.parts < given * total).all() and ((slots + 1) * r.parts > (given - 1) * total).all()


@pytest.mark.parametrize(("seed", "n"), [(0, 1), (1, 2), (2, 12), (3, 20), (4, 300)])
def test_schedule_keeps_windows_and_lag(spark, seed, n):
    draw = random.Random(seed)
    weights = {f"s{i:03}": draw.randint(1, 30) for i in range(n)}
    weights["s000"] += sum(weights.values()) // 2  # a third of all
    lags_stay_below_one_block(pfair.schedule(spark.createDataFrame(list(weights.items()), "key string, weight long")).collect(), weights)


def test_default_targets_are_close_to_the_power_of_the_sizes(spark):
    sizes = {f"s{i}": 10 + i**3 for i in range(40)}
    rows = spark.createDataFrame([(k, int(n**0.5 * 1000)) for k, n in sizes.items()], "key string, weight long")
    found = {r.key: r.weight for r in pfair.whole_parts(rows).collect()}
    total = sum(n**0.5 for n in sizes.values())
    assert all(abs(found[k] - max(1, pfair.PARTS * n**0.5 / total)) <= 0.51 for k, n in sizes.items())
    lags_stay_below_one_block(pfair.schedule(pfair.whole_parts(rows)).collect(), found)


def test_mix_follows_stated_weights(spark):
    docs = spark.createDataFrame([(i, "a" if i % 3 else None) for i in range(3000)], "doc_id long, source string")
    for a, null in ((1.0, 3.0), (0.25, 0.75), (10_000.0, 30_000.0)):
        weights = spark.createDataFrame([("a", a), (None, null)], "source string, weight double")
        rows = sorted(pfair.mix(docs, weights, block_rows=4).collect(), key=lambda r: r.mix_position)
        n_null = sum(r.source is None for r in rows[:800])
        assert len(rows) == 3000 and abs(n_null - 600) <= 8


# op7


def test_fit_learns_all_parts_of_long_words():
    pieces = langid.Pieces(["▁", "日", "本", "本本", "語"])
    first, second, third = ("日" * 32).encode(), ("本" * 32).encode(), "語語".encode()
    counts = np.array([[3.0, 1.0]])
    got = langid.fit_words(counts, [first + second + third], pieces)
    assert np.allclose(got, langid.fit_words(np.repeat(counts, 3, axis=0), [first, second, third], pieces))
    assert (got[4] > got[5]).all()  # a character after the first 32 counts more than one that never comes


def test_forward_sums_all_segmentations():
    pieces = langid.Pieces(["▁", "a", "b", "ab", "▁a", "ba", "▁ab", "aba"])
    p = np.random.default_rng(0).dirichlet(np.ones(9), 2).T
    listed = [b"abab", b"b", b"axb", b"ababab", b"aba"]
    lattice = langid.Lattice(pieces)
    ends, edges = lattice.add(listed)
    alpha = np.zeros((len(lattice.states), 2))
    alpha[0] = 1
    langid.forward(alpha, edges, p)
    for word, end in zip(listed, ends, strict=True):
        text = "▁" + word.decode()

        @lru_cache(None)
        def total(n, text=text):
            if n == 0:
                return 1.0
            out = 0.0
            for s in range(n):
                if text[s:n] in pieces.number:
                    out += total(s) * p[pieces.number[text[s:n]], 0]
                elif s == n - 1:
                    out += total(s) * p[-1, 0]
            return out

        assert abs(alpha[end, 0] - total(len(text))) < 1e-12
    # expected uses: by the derivative of the log-probability
    counts = np.array([[2.0, 1.0], [1.0, 0.0], [3.0, 1.0], [1.0, 1.0], [0.0, 5.0]])
    uses = langid.expected(edges, ends, len(lattice.states), p, counts)
    for k in range(9):
        up = p.copy()
        up[k, 0] *= 1.0001
        a = np.zeros_like(alpha)
        a[0] = 1
        langid.forward(a, edges, up)
        assert abs((counts[:, 0] * np.log(a[ends, 0] / alpha[ends, 0])).sum() / np.log(1.0001) - uses[k, 0]) < 1e-2


def test_language_held_out(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in QUERIES["op7_language"](spark, SF_MID).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in rows) > 0.95 * len(rows)


# op8


def test_label_model_finds_accuracies():
    draw = np.random.default_rng(0)
    truth = draw.random(20_000) < 0.85
    patterns = np.zeros((len(truth), len(quality.LABELLERS)), np.int64)
    patterns[:, 0] = np.where(~truth & (draw.random(len(truth)) < 0.5), -1, 0)
    patterns[:, 3] = np.where(~truth & (draw.random(len(truth)) < 0.3), -1, 0)
    for k in (6, 7):
        right = draw.random(len(truth)) < 0.9
        patterns[:, k] = np.where(right == truth, 1, -1)
    found, counts = np.unique(patterns, axis=0, return_counts=True)
    model = quality.fit_labels(found, counts)
    assert abs(model.prior - 0.85) < 0.05 and abs(model.rates[6, 1, 2] - 0.9) < 0.05
    assert ((model.posterior(patterns) > 0.5) == truth).mean() > 0.95


def test_quality_agrees_with_marks_it_never_saw(spark):
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_MID}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op8_quality"](spark, SF_MID).collect() if r.doc_id in marks]
    good, bad = ([r.keep for r in rows if marks[r.doc_id] == q] for q in (1, 0))
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)


# op9


def brute_classes(rows, idf):
    """Links between all pairs of texts, by exact weighted Jaccard similarity."""
    ids, texts = zip(*rows, strict=True)
    s = neardup.shingled([t.encode() for t in texts], neardup.WordHashes())
    weight = neardup.weights(s, idf)
    own = [dict(zip(s.ids[a:b].tolist(), weight[a:b].tolist(), strict=True)) for a, b in zip(s.starts, s.starts[1:], strict=False)]
    holders = defaultdict(list)
    for i, o in enumerate(own):
        for k in o:
            holders[k].append(i)
    up = list(range(len(ids)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    by_node = {}
    for i, n in enumerate(s.nodes.tolist()):
        up[root(i)] = root(by_node.setdefault(n, i))
    for i, o in enumerate(own):
        near = Counter()
        for k, w in o.items():
            for j in holders[k]:
                if j < i:
                    near[j] += min(w, own[j][k])
        for j, both in near.items():
            if both >= 0.8 * (sum(o.values()) + sum(own[j].values()) - both) - 1e-9:
                up[root(i)] = root(j)
    classes = defaultdict(set)
    for i in range(len(ids)):
        classes[root(i)].add(ids[i])
    return {frozenset(c) for c in classes.values()}


def found_classes(df):
    out = defaultdict(set)
    for r in df.collect():
        out[r.class_node].add(r.doc_id)
        assert r.class_id <= r.doc_id
    return {frozenset(c) for c in out.values()}


def test_near_duplicates_of_the_small_table(spark, docs):
    table = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert found_classes(neardup.classes(table)) == brute_classes(sorted(docs.items()), neardup.idf_of(table))


def hot_rows():
    """Copies, edited copies of one text (alike to it, less to each other), and texts that share a passage."""
    draw, base, passage = random.Random(5), prose(7, 150).split(), prose(9, 40)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows = [" ".join(base)] * 20
    for _ in range(60):
        own = list(base)
        for _ in range(draw.randint(1, 4)):
            own[draw.randrange(len(own))] = draw.choice(vocabulary)
        rows.append(" ".join(own))
    rows += [passage + " " + " ".join(draw.choice(vocabulary) for _ in range(60)) for _ in range(60)]
    rows += [" ".join(draw.choice(vocabulary) for _ in range(30)) for _ in range(40)]
    draw.shuffle(rows)
    return list(enumerate(rows))


def test_split_tasks_lose_no_link(spark):
    table = spark.createDataFrame(hot_rows(), "doc_id long, text string").repartition(3)
    want = brute_classes(hot_rows(), neardup.idf_of(table))
    assert max(map(len, want)) > 40
    for task_nodes in (512, 7):  # whole component in a task; buckets in grids of blocks
        assert found_classes(neardup.classes(table, task_nodes=task_nodes)) == want


def test_idf_counts_frequent_shingles_exactly(spark):
    table = spark.createDataFrame(hot_rows(), "doc_id long, text string").repartition(4)
    found = neardup.idf_of(table, rare=0.1, block_ids=5)
    s = neardup.shingled([t.encode() for _, t in hot_rows()], neardup.WordHashes())
    pairs = set(zip(s.ids.tolist(), np.repeat(s.sketches(), np.diff(s.starts)).tolist(), strict=True))
    df, n = Counter(k for k, _ in pairs), len(hot_rows())
    want = {k: min(1, max(0.05, math.log(n / c) / math.log(10))) for k, c in df.items() if c > 0.1 * n}
    assert want and set(want) == set(found.ids.tolist())
    assert all(abs(want[k] - w) < 1e-5 for k, w in zip(found.ids.tolist(), found.weights.tolist(), strict=True))


def spread_rows(n=400):
    """Texts of own words; a fifth hold one passage, every fiftieth another; one text stands there a hundred times."""
    draw = random.Random(3)
    rows = [" ".join(f"w{draw.randrange(100_000)}" for _ in range(30)) for _ in range(n)]
    rows = [t + (" pa pb pc pd pe" if i % 50 == 0 else "") + (" qa qb qc qd qe" if i % 200 == 0 else "") for i, t in enumerate(rows)]
    return list(enumerate(rows + ["one two three four five six seven"] * 100))


def test_every_shingle_has_its_own_idf(spark):
    """Below the share ``rare`` too: shared passages weigh less than what one text holds alone, copies do not count."""
    table = spark.createDataFrame(spread_rows(), "doc_id long, text string").repartition(4)
    found = neardup.idf_of(table)
    s = neardup.shingled([t.encode() for _, t in spread_rows()], neardup.WordHashes())
    pairs = set(zip(s.ids.tolist(), np.repeat(s.sketches(), np.diff(s.starts)).tolist(), strict=True))
    df, n = Counter(k for k, _ in pairs), len(spread_rows())
    ids = np.array(sorted(df), np.uint64)
    weight = found.of(ids)
    want = np.array([math.log(n / df[k]) / math.log(1 / neardup.RARE) for k in ids.tolist()])
    error = weight - want
    assert (weight >= 1).all() and weight.max() > 1.5
    assert abs(error.mean()) < 0.1 and np.abs(error).mean() < 0.25  # four draws: about 0.5 / ln(1 / rare)
    passage = np.array([df[k] >= 8 for k in ids.tolist()])
    assert passage.any() and weight[passage].mean() < weight[~passage].mean() - 0.4
    again = neardup.idf_of(table.repartition(7))
    assert (again.of(ids) == weight).all()


def test_samples_agree_as_weights_do():
    draw = np.random.default_rng(0)
    sampler = neardup.Sampler(2000)
    ids = np.arange(1, 401).astype(np.uint64) * np.uint64(7919)
    w1 = draw.choice([0.3, 1.0, 1.7], 400).astype(np.float32)
    w2 = np.where(draw.random(400) < 0.8, w1, draw.choice([0.3, 1.0, 1.7], 400)).astype(np.float32)
    s = neardup.Shingled(np.concatenate((ids, ids)), np.ones(800, np.int64), np.array([0, 400, 800]), np.zeros(2, np.int64))
    a, b = sampler(s, np.concatenate((w1, w2)))
    assert abs((a == b).mean() - np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()) < 0.05


# op10


def test_toxicity_held_out(spark):
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF_MID}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op10_toxicity"](spark, SF_MID).collect() if r.doc_id in marks and r.held_out]
    caught = [r for r in rows if r.predicted]
    assert rows and all(marks[r.doc_id] == 1 for r in caught) and all(r.predicted == (r.score >= 0.5) for r in rows)
    assert len(caught) >= 0.5 * sum(marks[r.doc_id] for r in rows)


def test_isotonic_steps():
    x, y = toxicity.isotonic(np.array([1.0, 2, 3, 3, 4]), np.array([0.0, 1, 0, 1, 1]))
    assert list(y) == sorted(y) and len(x) == len(y) and y[0] == 0 and y[-1] == 1


# pipeline


def test_pipeline_stages_take_effect(spark, docs):
    table = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality", "near duplicates", "decontaminate", "mix"]
    labels, bench = spark.read.parquet(f"{SF_SMALL}/labels.parquet"), spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    now = {r.doc_id: r.text for r in table.collect()}
    model = toxicity.fit(table, labels)
    now = {i: t for i, t in now.items() if toxicity.score_texts(model, [(t or "").encode()])[0] < 0.5}
    kept = table.where(table.doc_id.isin(list(now)))
    scorer = quality.fit(kept)
    now = {i: t for i, t in now.items() if quality.score_texts(scorer, [(t or "").encode()])[0] >= 0.5}
    kept = kept.where(kept.doc_id.isin(list(now)))
    now = {min(c): now[min(c)] for c in brute_classes(sorted((i, t or "") for i, t in now.items()), neardup.idf_of(kept))}
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, SF_SMALL).collect()}
    assert set(rows) == set(now)
    items = [(str(r.item_id), (r.text or "").encode()) for r in bench.collect()]
    for i, r in rows.items():
        if r.text != now[i]:
            assert brute_windows(items, now[i].encode())[0] > 0
        assert brute_windows(items, (r.text or "").encode())[0] == 0
    assert sorted({r.mix_position for r in rows.values()}) == sorted(r.mix_position for r in rows.values())


def test_model_and_head_do_not_depend_on_files(spark):
    docs = spark.createDataFrame([(i, prose(i, 30), "en") for i in range(60)], "doc_id long, text string, lang string")
    fold = F.col("doc_id") % 10 != 0
    runs = [{r.doc_id: r.score for r in gru_lm.score(docs.repartition(n), fold, shard_docs=20, rates=(0.02,)).collect()} for n in (1, 5)]
    assert all(abs(runs[0][i] - runs[1][i]) < 1e-3 for i in runs[0])
    counts = spark.createDataFrame([(f"w{i}", 1 + 5000 // (i + 1)) for i in range(3000)], "token string, c long")
    old = gru_lm.HEAD
    try:
        gru_lm.HEAD = 100
        least = gru_lm.head_count(counts)
        assert 50 <= counts.where(F.col("c") >= least).count() <= 100
        gru_lm.HEAD = 5000
        assert gru_lm.head_count(counts) == counts.agg(F.min("c")).first()[0]
    finally:
        gru_lm.HEAD = old


def test_gru_training_lanes_take_every_token_once(monkeypatch):
    draw = np.random.default_rng(4)
    docs = [draw.integers(1, 50, n).astype(np.int32) for n in (0, 3, 700, 1, 40, 41)]
    seen = []

    def window(self, units, target, keep, state, grads):
        seen.append((units, target, keep))
        return 0.0, state

    monkeypatch.setattr(gru_lm.Gru, "window", window)
    gru_lm.train(gru_lm.Gru(60), docs, 0, 0.01, lanes=8)
    units, target, keep = (np.concatenate(x).T for x in zip(*seen, strict=True))  # lanes x steps
    some = target.ravel() >= 0
    assert units.ravel()[some].tolist() == [u for d in docs for u in (0, *d)]
    assert target.ravel()[some].tolist() == [u for d in docs for u in (*d, 0)]
    assert np.flatnonzero(keep.ravel() == 0).tolist() == np.cumsum([0, *(len(d) + 1 for d in docs)])[:-1].tolist()
    assert all(t.size - (t >= 0).sum() < 8 * gru_lm.WINDOW for _, t, _ in seen)  # padding at the end only


def test_gru_scores_do_not_depend_on_blocks():
    units = gru_lm.Units.of([(f"w{i}", 50 - i) for i in range(40)], 10, np.full(gru_lm.BUCKETS, 2.0))
    model = gru_lm.Gru.start(units)
    texts = [np.random.default_rng(k).integers(0, 60, n).astype(np.int32) for k, n in enumerate((900, 0, 5, 5, 5, 33, 1))]
    want = gru_lm.score_docs(model, texts, units.end)
    for lanes, columns in ((1, 10), (3, 64), (7, 1)):
        assert np.allclose(gru_lm.score_docs(model, texts, units.end, lanes, columns), want, rtol=1e-5)


def test_model_and_stored_parameters_do_not_depend_on_partitions(spark, monkeypatch):
    """However many partitions a keyed repartition makes, shards stay the same; what is stored of them are sums over 64."""
    docs = spark.createDataFrame([(i, prose(i, 30), "en") for i in range(300)], "doc_id long, text string, lang string")
    stored, average, repartition = [], gru_lm.average, type(docs).repartition

    def seen(shards):
        stored.append(shards.select("shard").distinct().count())
        return average(shards)

    def scores():
        return {r.doc_id: r.score for r in gru_lm.score(docs, F.col("doc_id") % 10 != 0, shard_docs=3, rates=(0.02,)).collect()}

    monkeypatch.setattr(gru_lm, "average", seen)
    want = scores()
    monkeypatch.setattr(type(docs), "repartition", lambda self, n, *cols: repartition(self, n + 50 if cols else n, *cols))
    got = scores()
    assert stored == [2, 2] and all(abs(got[i] - want[i]) < 1e-3 for i in want)


def test_words_are_counted_once_and_looked_up_alike(spark, monkeypatch):
    """Units, base and known words of texts with words outside the head, of one or two characters, beyond ASCII, repeated, or none."""
    texts = ["a a bb \u00e9 x\u00e9 \u00e9x zz\u20ac", "rare rare a", "", None, " \t\n", "\U0001f600\U0001f600 a bb", "bb new new2 \u00e9"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(gru_lm, "HEAD", 3)
    rows = gru_lm.score(docs, F.when(F.col("doc_id") < 6, True), rates=(0.02,)).collect()
    own = [(t or "").lower().split() + [None] for t in texts]
    counts = Counter(w for o in own[:6] for w in o)
    n, v = sum(counts.values()), len(counts)
    assert sorted(r.doc_id for r in rows) == list(range(7))
    for r in rows:
        words = own[r.doc_id]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(counts[w] > 0 for w in words), n)
        assert abs(base - r.base_score) < 1e-6 and r.score < 0
    words = [w.encode() for o in own for w in o if w]
    want = [zlib.crc32(w.decode()[-2:].encode()) % gru_lm.BUCKETS for w in words]
    assert gru_lm.bucket_numbers(words, {}).tolist() == want == gru_lm.bucket_numbers(words, {b"bb": zlib.crc32(b"bb") % gru_lm.BUCKETS}).tolist()
