"""Fill-in-middle forms, SimHash components and vector codes against brute force and on awkward rows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from suiteforge.llm import ball_codes, infill, simhash
from suiteforge.llm.queries import QUERIES

from .conftest import SF_SMALL, edge_rows

# op11


def cut_by_hand(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 50 else "psm"
    return len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


AWKWARD = [
    (1, "\n"), (2, "\n\n\nx"), (3, "no line feed"), (4, "a\r\nb c\u0085d\n"), (5, "holds <S> itself\nand more\n"), (6, "a <\nP>b $1 \\2 {3}\n" * 3),
    (7, "\U0001f600\n" * 50), (8, "line\n" * 200_000), (9, "y" * 300_000 + "\n" + "z" * 300_000), (10, "<P"), (10, "<P"), (None, "a\nb\nc"), (11, None), (12, ""), (13, "<\n<S\n<M\n"),
]


def test_infill_by_hand(spark):
    rows = AWKWARD + [(r[0], r[1]) for r in edge_rows()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("form", F.lit("clash")).withColumn("n", F.lit(1))
    found = infill.transform(docs).withColumn("restored", infill.restore(F.col("output"), F.col("form"))).collect()
    assert sorted(map(str, ((r.doc_id, r.n_units, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found))) == sorted(map(str, ((i, *cut_by_hand(i, t)) for i, t in rows)))
    assert sorted((str(r.doc_id), r.restored) for r in found) == sorted((str(i), t or "") for i, t in rows)
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_infill_other_units_markers_and_shares(spark):
    docs = spark.createDataFrame([(str(k), f"word{k}  two\n three $x .{k}") for k in range(200)], "doc_id string, text string")
    found = infill.transform(docs, unit=infill.WORDS, seed="s", percent=70, spm_percent=100, markers=("[p$]", "(s)", "\\m")).collect()
    assert {r.form for r in found} == {"plain", "spm"} and 30 < sum(r.form == "plain" for r in found) < 90
    assert all(r.n_units == 5 for r in found)
    back = infill.transform(docs, markers=("[p$]", "(s)", "\\m")).select(infill.restore(F.col("output"), F.col("form"), ("[p$]", "(s)", "\\m")).alias("t"))
    assert sorted(r.t for r in back.collect()) == sorted(r.text for r in docs.collect())
    with pytest.raises(ValueError, match="form"):
        infill.transform(docs.withColumn("form", F.lit(1)), keep=("doc_id", "form"))


def test_infill_plan_is_row_local(spark):
    plan = QUERIES["op11_infill"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


# op12


def fingerprint_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(values, radius):
    """Label of every distinct value: the smallest value that it reaches."""
    distinct = np.array(sorted(set(values)), np.uint64)
    near = np.bitwise_count(distinct[:, None] ^ distinct[None, :]) <= radius
    label = np.arange(len(distinct))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return {int(v): int(distinct[k]) for v, k in zip(distinct, label, strict=True)}
        label = new


def test_simhash_by_hand(spark, edge_dir):
    tables = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    for folder, rows in ((SF_SMALL, tables), (edge_dir, [(r[0], r[1]) for r in edge_rows()])):
        prints = [fingerprint_by_hand(t) for _, t in rows]
        label, least = components_by_hand(prints, 3), {}
        for (i, _), f in zip(rows, prints, strict=True):
            least[label[f]] = min([x for x in (i, least.get(label[f])) if x is not None], default=None)
        found = QUERIES["op12_simhash"](spark, folder).collect()
        assert sorted(map(str, map(tuple, found))) == sorted(str((i, f"{f:016x}", least[label[f]])) for (i, _), f in zip(rows, prints, strict=True))


def planted(seed, n):
    """Random values with chains and dense groups of near ones, and a third that share their first 40 bits."""
    draw = random.Random(seed)
    out = []
    while len(out) < n:
        at = draw.getrandbits(64) if draw.random() < 0.6 else 0xABCDEF0123 << 24 | draw.getrandbits(24)
        for _ in range(draw.choice([1, 1, 1, 2, 5, 30])):
            out.append(at)
            for _ in range(draw.randint(1, 4)):
                at ^= 1 << draw.randrange(64)
    return out


@pytest.mark.parametrize("limits", [{}, {"blocks": 5}, {"blocks": 6, "shard_nodes": 8}, {"shard_nodes": 16, "broadcast_bytes": 4000}, {"shard_nodes": 64, "piece": 10}])
def test_links_have_the_components_of_all_pairs(spark, limits):
    for radius in (3, 1):
        values = planted(radius, 1500)
        nodes = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in set(values)], "fingerprint long").repartition(3)
        links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(nodes, radius, **limits).collect()]
        assert all((a ^ b).bit_count() <= 64 for a, b in links)
        label = components_by_hand(values, radius)
        assert all(label[a] == label[b] for a, b in links)
        parent = {v: v for v in values}

        def root(v):
            while parent[v] != v:
                v = parent[v]
            return v

        for a, b in links:
            parent[max(root(a), root(b))] = min(root(a), root(b))
        assert {v: root(v) for v in values} == label


def test_bk_tree_follows_only_edges_within_the_radius():
    values = np.array(sorted(set(planted(9, 400))), np.uint64)
    trees = simhash.plant(values, np.zeros(len(values), np.int64))
    parent, distance = trees.edge // 65, trees.edge % 65
    assert sorted(trees.child) == list(range(1, len(values))) and len(set(trees.edge)) == len(trees.edge)
    assert (np.bitwise_count(values[parent] ^ values[trees.child]) == distance).all()
    for front in (1 << 19, 7):
        hits = [(int(q), int(i)) for a, b in simhash.search(trees, values, np.zeros(len(values), np.int64), 3, front) for q, i in zip(a, b, strict=True)]
        near = np.argwhere(np.bitwise_count(values[:, None] ^ values[None, :]) <= 3)
        assert sorted(hits) == sorted(map(tuple, near.tolist()))


def test_simhash_text_ids(spark):
    docs = spark.createDataFrame([("b", "one two three four"), ("a", "one two three four"), ("c", ""), (None, " ")], "name string, body string")
    found = {r.name: r.component_id for r in simhash.components(docs, "name", "body").collect()}
    assert found == {"a": "a", "b": "a", "c": "c", None: "c"}


# op13


def codes_by_hand(rows, parts=4, entries=256, rounds=4):
    """rows of (id, vector, label) that are kept, in order of id."""
    x = np.array([[int(np.floor(1024 * float(v))) for v in vec] for _, vec, _ in rows])
    cut = np.array_split(np.arange(x.shape[1]), parts)
    codes, errors, books = [], 0, []
    for at in cut:
        part, book = x[:, at], x[:entries, at].copy()
        for k in range(rounds + 1):
            d = ((part[:, None, :] - book[None, :, :]) ** 2).sum(2)
            code = d.argmin(1)
            if k < rounds:
                for c in set(code.tolist()):
                    book[c] = part[code == c].sum(0) // (code == c).sum()
        codes.append(code)
        errors = errors + d.min(1)
        books.append(book)
    labels = {}
    for (_, _, lab), e in zip(rows, errors, strict=True):
        labels[lab] = labels.get(lab, 0) + int(e)
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()
    return [(i, "".join(f"{c[k]:02x}" for c in codes), int(errors[k]), labels[lab], digest) for k, (i, _, lab) in enumerate(rows)]


def vectors(seed, n, dim, spread=0.02):
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(12, dim))
    return (middle[draw.integers(0, 12, n)] + spread * draw.normal(size=(n, dim))).astype(np.float32)


def write_vectors(path, rows):
    table = pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())), "label": pa.array([r[2] for r in rows], pa.int32())})
    pq.write_table(table.append_column("kept", pa.array(["x"] * len(rows), pa.string())).append_column("_label", pa.array([1] * len(rows), pa.int32())), f"{path}/embeddings.parquet", row_group_size=200)
    return str(path)


@pytest.mark.parametrize(("seed", "n", "dim", "spread"), [(1, 900, 8, 0.02), (2, 700, 16, 0.5), (3, 100, 4, 0.1), (4, 400, 8, 0.0)])
def test_codes_by_hand(spark, tmp_path, seed, n, dim, spread):
    made = vectors(seed, n, dim, spread)
    rows = [(k, list(v), None if k % 3 == 0 else k % 2) for k, v in enumerate(made)]
    bad = [(-5, None, 1), (-4, [float("nan")] * dim, 1), (-3, [None] + [0.0] * (dim - 1), 1), (-2, [float("inf")] * dim, 2), (-1, [], 2)]
    folder = write_vectors(tmp_path, random.Random(seed).sample(rows + bad, len(rows) + len(bad)))
    found = QUERIES["op13_vector_codes"](spark, folder)
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, found.collect())) == codes_by_hand(rows)


def test_codes_of_repeats_odd_lengths_and_nothing(spark, tmp_path):
    rows = [(3, [1.0, 2.0, 3.0, 4.0, 5.0], 1)] * 3 + [(None, [1.0, 2.0, 3.0, 4.0, 7.0], None), (4, [1.0, 2.0], 1), (5, [1e9] * 5, 1)]
    found = sorted(map(str, map(tuple, QUERIES["op13_vector_codes"](spark, write_vectors(tmp_path, rows)).collect())))
    assert found == sorted(map(str, codes_by_hand(rows[:4])))
    for empty in ([], [(1, None, 1)]):
        assert QUERIES["op13_vector_codes"](spark, write_vectors(tmp_path, empty)).collect() == []


def test_balls_compare_less_and_find_the_same(spark):
    x = (1024 * vectors(7, 3000, 8, 0.05)).astype(np.int64)
    book = x[:256].copy()
    code, _ = ball_codes.nearest(x, book)
    moved_book = book.copy()
    moved_book[::3] += 2
    moved = (moved_book != book).any(1)
    compared = []
    plain = ball_codes.squared
    try:
        ball_codes.squared = lambda a, b: compared.append(len(a) * len(b)) or plain(a, b)
        found = ball_codes.nearest_by_balls(x, moved_book, plain(moved_book, moved_book), code, moved)
        work = sum(compared)
    finally:
        ball_codes.squared = plain
    expected = ball_codes.nearest(x, moved_book)
    assert (found[0] == expected[0]).all() and (found[1] == expected[1]).all()
    assert work < 0.5 * len(x) * len(book)
