"""Centroids, manifests and reply trees against brute-force versions, their SQL, and on edge rows."""

import hashlib
import math
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from triagelake.llm import catalog, centroids, chat, manifest

SF = "/root/testdata/sf0.001"


def same(got, want):
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = catalog.queries()[name](spark, SF), con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    same(got.select(*names).collect(), want.fetchall())


# ---- 11 --------------------------------------------------------------------


def clusters(rows, k, dims, rounds, scale=64, seed=1):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in first[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cents))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        cents = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(cents)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    total = sum(d for _, _, d in found)
    return [(i, c, d, sum(e for _, b, e in found if b == c), total, hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for i, c, d in found]


VECTORS = "vec_id long, embedding array<float>, cluster string, v int, distance double, n long"


@pytest.mark.parametrize("n", [0, 1, 3, 200])
def test_lloyd_equals_brute_force(spark, n):
    r = random.Random(n)
    vec = lambda: [r.choice([-1, 0, 1]) * r.randint(0, 40) / 16 for _ in range(5)]
    rows = [(i, vec()) for i in range(n)] + ([(3, [0.5] * 5)] * 70 + [(None, [-0.25] * 5), (None, None), (7, [])] if n else [])
    rows += [(900, [1.0, None, 0.0, 0.0, 0.0]), (901, [float("nan")] * 5), (902, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (903, [1.0] * 4), (904, [1.0] * 6)]
    df = spark.createDataFrame([(*x, "c", 1, 2.0, 3) for x in rows], VECTORS)
    same(centroids.clustered(spark, df, k=4, dims=5, rounds=3).collect(), clusters(rows, 4, 5, 3))


def test_far_components_do_not_overflow(spark):
    df = spark.createDataFrame([(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.0] * 64)], "vec_id long, embedding array<float>")
    got = centroids.clustered(spark, df, k=2).collect()
    assert len(got) == 3 and all(x["distance"] >= 0 for x in got)


# ---- 12 --------------------------------------------------------------------


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def merkle(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of rows (doc_id, source, lang, n_chars, text)."""
    def tree(nodes):
        """The root, and each node's (before, after) by level."""
        roads, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, place in enumerate(at):
                first = place // 16 * 16
                roads[k].append(("".join(nodes[first:place]), "".join(nodes[place + 1 : first + 16])))
            nodes = [h("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
            at = [p // 16 for p in at]
        return (nodes or [None])[0], roads

    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        subs[s] = tree([leaf_of(r) for r in groups[s]])
    root, tops = tree([subs[s][0] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        for r, road in zip(groups[s], subs[s][1], strict=True):
            path = road + top
            folded = leaf_of(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                folded = leaf_of((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for b, a in path:
                folded = h(b + folded + a)
            out.append((r[0], leaf_of(r), subs[s][0], root, h("".join(b + a for b, a in path)), folded, folded == root))
    return out


DOCS = "doc_id long, source string, lang string, n_chars long, text string, h string, gid long, idx int, path string"


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17, 700])
def test_manifest_equals_brute_force(spark, n, tmp_path):
    r = random.Random(n)
    rows = [(i, r.choice([None, "hot", "hot", "hot", "", "ü", f"s{r.randint(0, 20)}"]), r.choice([None, "en"]), r.choice([None, 5]), r.choice([None, "", "A b", "ÄÖ Z" * 50, f"t{i}"])) for i in range(n)]
    if n > 100:
        rows += [rows[0]] * 40 + [(None, "hot", None, None, None)] * 3 + [(5, "hot", "x", 1, "Other"), (6, "only", None, 0, "Q" * 300_000)]
    spark.createDataFrame([(*x, "h", 1, 2, "p") for x in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = manifest.op12_merkle(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    same(got.collect(), merkle(rows))


# ---- 13 --------------------------------------------------------------------

BITS = [*chat.CONTROLS, "\\", "\\\\", "\n", "<", "[", "|", ">", "a", "É", "😀", "</", "s>", "INST]", "<|im_", "sep|>", "<\\/s>", "$1"]


def words(r, most=12):
    return "".join(r.choice(BITS) for _ in range(r.randint(0, most)))


def esc(text):
    text = text.replace("\\", "\\\\")
    for c in chat.CONTROLS:
        text = text.replace(c, c[0] + "\\" + c[1:])
    return text


def test_escapes_come_back_and_leave_no_control_string(spark):
    r = random.Random(5)
    texts = [words(r) for _ in range(3000)] + ["", "\\", "<" * 50 + "</s>" * 50, "[" * 9 + "INST]"]
    got = [x[0] for x in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(chat.escape(F.col("t"))).collect()]
    assert got == [esc(t) for t in texts]
    assert [chat.unescape(x) for x in got] == texts
    assert not any(c in x for x in got for c in chat.CONTROLS)


def digests(conv, turns):
    said = [(role or "", text or "") for role, text in turns]
    learned = [t for role, t in said if role == "assistant"]
    chars = sum(len(chat.START + chat.SEP + chat.END) + len(esc(a)) + len(esc(b)) for a, b in said)
    return (conv, len(said), h("".join(f"{a}\n{b}\n" for a, b in said)), sum(map(len, learned)), h("".join(learned)), chars)


MESSAGES = "conv_id long, node long, parent long, role string, text string, score double, leaf string, key string, at int"


def best_branches(rows, keep):
    """(conv_id, turns) of the chosen branches, by plain walks; rows are (conv_id, node, parent, role, text, score) with unique nodes."""
    out = []
    for conv in {x[0] for x in rows}:
        mine = {x[1]: x for x in rows if x[0] == conv}
        up = {n: x[2] if x[2] in mine and x[2] < n else None for n, x in mine.items()}
        branches = []
        for leaf in set(mine) - set(up.values()):
            walk, n = [], leaf
            while n is not None:
                walk.append(mine[n])
                n = up[n]
            branches.append((-sum(x[5] or 0.0 for x in walk) / len(walk), -len(walk), leaf, [(x[3], x[4]) for x in reversed(walk)]))
        out += [(conv, b[3]) for b in sorted(branches)[:keep]]
    return out


@pytest.mark.parametrize("keep", [1, 3, None])
def test_trees_equal_brute_force(spark, keep):
    r = random.Random(11)
    rows = []
    for conv in [None, *range(25)]:
        size = r.choice([1, 2, 5, 40, 90])
        for n in range(size):
            parent = r.choice([None, n, n + 1, 1000, *[max(n - 1, 0)] * 8, r.randint(0, n)])
            rows.append((conv, n, parent, r.choice(["user", "assistant", "assistant", None, "<|im_sep|>\n"]), r.choice([None, "", words(r), "text"]), r.choice([None, 0.0, 0.25, 1.0, -0.5])))
    df = spark.createDataFrame([(*x, "l", "k", 1) for x in rows], MESSAGES)
    got = chat.read_trees(chat.format_trees(spark, df, keep=keep)).drop("leaf").collect()
    same(got, [digests(c, t) for c, t in best_branches(rows, keep)])


def test_chains_repeats_and_long_conversations(spark):
    r = random.Random(4)
    rows = [(1, n, r.choice(["user", "assistant"]), words(r)) for n in range(0, 3000, 3)]  # 1,000 turns with gaps, many blocks
    rows += [(2, None, "system", "none"), (2, 5, "b", "later"), (2, 5, "a", "earlier"), (None, 0, None, None), (3, 0, "assistant", "x" * 400_000), (3, 1, "user", "")]
    twice = [(4, 0, "user", "same")] * 3 + [(4, 1, "assistant", "<s>")] * 2
    df = spark.createDataFrame(rows + twice, "conv_id long, node long, role string, text string")
    got = chat.read_trees(chat.format_trees(spark, df, linear=True)).drop("leaf").collect()
    want = {}
    for c, n, role, text in sorted(rows + twice, key=lambda x: (x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "")):
        want.setdefault(c, []).append((role, text))
    same(got, [digests(c, t) for c, t in want.items()])


def test_a_text_on_very_many_paths(spark, monkeypatch):
    monkeypatch.setattr(chat, "CROWD", 50)
    rows = [(1, 0, None, "user", "trunk", 0.0)] + [(1, n, 0, "assistant", f"r{n}", 0.0) for n in range(1, 400)]
    got = chat.read_trees(chat.format_trees(spark, spark.createDataFrame([(*x, "l", "k", 1) for x in rows], MESSAGES), keep=None))
    same(got.drop("leaf").collect(), [digests(1, [("user", "trunk"), ("assistant", f"r{n}")]) for n in range(1, 400)])


def test_no_conversations(spark):
    empty = spark.createDataFrame([], MESSAGES)
    assert chat.read_trees(chat.format_trees(spark, empty)).count() == 0
    assert chat.read_trees(chat.format_trees(spark, empty, linear=True)).count() == 0


def test_loss_spans_mark_assistant_text(spark):
    rows = [(1, 0, "user", "q </s>"), (1, 1, "assistant", "a [INST]"), (1, 2, "assistant", "")]
    got = chat.format_trees(spark, spark.createDataFrame(rows, "conv_id long, node long, role string, text string"), linear=True).first()
    assert got["text"] == "<|im_start|>user<|im_sep|>q <\\/s><|im_end|><|im_start|>assistant<|im_sep|>a [\\INST]<|im_end|><|im_start|>assistant<|im_sep|><|im_end|>"
    assert [got["text"][s : s + n] for s, n in zip(got["loss_start"], got["loss_length"], strict=True)] == ["a [\\INST]", ""]
