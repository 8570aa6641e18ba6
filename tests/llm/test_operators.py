"""The ten operators and the pipeline, each against a brute-force version or an exact round trip, and on edge rows."""

import base64
import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
import duckdb
import public_tokenizers
from triagelake.llm import arrow, audio, bpe, catalog, decontaminate, line_dedup, near_duplicates, sharding, token_counts, toxicity, url_filter, warc
from triagelake.llm.graph import components
from triagelake.llm.shared import Scratch

BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, id long, n int, score string, h string, gone boolean, lines_removed int, component_id long"


def prose(r, n):
    return " ".join(r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(n))


def edge_texts():
    r = random.Random(3)
    long = prose(r, 6000)
    return [None, "", " ", "\n\n", "a", "A b", long, long, long + " end", prose(r, 40), "é日本語 😀　x" * 9, "tab\tand nbsp\u0085\x1c\r\n  x", "<s> <|endoftext|> </s>", "\0\0", "a" * 3000]


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def edge_docs(spark):
    """Nulls in any column, ties and repeated rows, very long texts, extra columns with names that operators use inside."""
    rows = [(i, t) for i, t in enumerate(edge_texts())] + [(None, "no id"), (None, None), (5, "A b"), (5, "A b"), (3, "other text under one id")]
    return frame(spark, [(*r, None, None, None, 1, 2, "s", "h", None, 4, 5) for r in rows], EXTRA), rows


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_catalog():
    names = catalog.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))


# ---- 1 and the graph -------------------------------------------------------


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i in up}


def near_texts(seed):
    r = random.Random(seed)
    out = []
    for _ in range(25):
        words = prose(r, r.choice([3, 8, 30, 60, 120])).split()
        for _ in range(r.randint(1, 7)):
            copy = list(words)
            for _ in range(r.randint(0, max(1, len(words) // 25))):
                copy[r.randrange(len(copy))] = "edit" + str(r.randint(0, 5))
            out.append(" ".join(copy) if r.random() < 0.9 else "\n".join(copy).upper())
    return out


@pytest.mark.parametrize(("k", "percent", "seed"), [(3, 90, 1), (5, 80, 2)])
def test_near_duplicates(spark, k, percent, seed):
    rows = list(enumerate(near_texts(seed)))
    got = {r["doc_id"]: r for r in near_duplicates.near_duplicates(frame(spark, rows), k, percent).collect()}
    want = brute_components(rows, k, percent)
    assert {i: r["component_id"] for i, r in got.items()} == want and len(set(want.values())) < len(rows)
    assert all(got[i]["n_shingles"] == len(shingles(t, k)) for i, t in rows)


def test_near_duplicates_edges(spark):
    docs, rows = edge_docs(spark)
    got = near_duplicates.near_duplicates(docs, 3, 90).collect()
    want = brute_components(rows, 3, 90)
    same([tuple(r) for r in got], [(i, len(shingles(t, 3)), None if i is None else want[i]) for i, t in rows])
    assert near_duplicates.near_duplicates(docs.limit(0)).count() == 0
    kept = near_duplicates.keep_one(docs, 3, 90)
    assert kept.columns == docs.columns
    same([(r["doc_id"], r["text"]) for r in kept.collect()], [x for x in {x for x in rows if x[0] is not None} if want[x[0]] == x[0]] + [(None, "no id"), (None, None)])


def test_repeated_ids_keep_their_links(spark):
    a, b = prose(random.Random(16), 60), prose(random.Random(17), 60)
    rows = [(1, a), (5, a), (5, b), (3, b.rsplit(" ", 1)[0]), (7, b), (7, b), (8, prose(random.Random(18), 9))]
    got = near_duplicates.near_duplicates(frame(spark, rows), 3, 90).collect()
    want = brute_components(rows, 3, 90)
    same([(r["doc_id"], r["component_id"]) for r in got], [(i, want[i]) for i, _ in rows])
    assert want == {1: 1, 5: 1, 3: 1, 7: 1, 8: 8}
    # 5 has two texts; each goes with its own likes, and no text is lost
    same([(r["doc_id"], r["text"]) for r in near_duplicates.keep_one(frame(spark, rows), 3, 90).collect()], [rows[0], rows[3], rows[-1]])


def test_keep_one_loses_no_text(spark):
    """Repeated ids at random: one row stays for each component of texts, and every text has a kept one in its component."""
    r = random.Random(33)
    base = [prose(r, 40) for _ in range(8)]
    rows = [(r.randint(1, 12), r.choice(base).rsplit(" ", r.randint(1, 3))[0]) for _ in range(60)] + [(None, base[0])] * 2 + [(3, None), (4, ""), (4, "")]
    docs = frame(spark, [(i, t, k, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, id long, row long")
    kept = near_duplicates.keep_one(docs, 3, 90)
    assert kept.columns == docs.columns
    texts = sorted({t for i, t in rows if t and i is not None})
    comp = brute_components(list(enumerate(texts)), 3, 90)
    of = {t: comp[k] for k, t in enumerate(texts)}
    got = [(x["doc_id"], x["text"]) for x in kept.collect()]
    named = [x for x in got if x[0] is not None and x[1]]
    assert len(named) == len(set(of.values())) == len({of[t] for _, t in named})
    assert {of[t]: i for i, t in named} == {c: min(i for i, t in rows if i is not None and t and of[t] == c) for c in of.values()}
    same([x for x in got if x not in named], [(None, base[0])] * 2 + [(3, None), (4, "")])


def test_components(spark):
    r = random.Random(4)
    chain = [(i, i + 1) for i in range(60)]
    edges = chain + [(r.randint(100, 160), r.randint(100, 160)) for _ in range(40)] + [(500, i) for i in range(501, 530)]
    r.shuffle(edges)
    up = {x: x for e in edges for x in e}
    for _ in range(len(up)):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = components(frame(spark, edges, "a long, b long"), Scratch(spark)).collect()
    assert {r["id"]: r["component"] for r in got} == {x: c for x, c in up.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert components(frame(spark, [], "a long, b long"), Scratch(spark)).count() == 0


# ---- 2 ---------------------------------------------------------------------


def fewest_edits(item, text):
    row = [0] * (len(text) + 1)
    for k, c in enumerate(item, 1):
        new = [k]
        for j in range(1, len(text) + 1):
            new.append(min(row[j - 1] + (text[j - 1] != c), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def folded(text):
    return re.sub(r"\s+", " ", (text or "").lower()).strip()


def test_leaks(spark):
    r = random.Random(5)
    items = [(k, prose(r, 12)) for k in range(5)] + [(8, "Short"), (9, ""), (None, None)]
    docs = [(None, "x"), (1, None), (2, ""), (3, "a short one"), (3, "a short one")]
    for i in range(10, 40):
        t = list(folded(items[r.randrange(5)][1]))
        for _ in range(r.randint(0, 12)):
            p = r.randrange(len(t))
            t[p : p + 1] = r.choice([[], ["q"], [t[p], "q"]])
        docs.append((i, prose(r, r.randint(0, 30)) + " \n" + "".join(t).upper() + " " + prose(r, 5)))
    df, bench = frame(spark, docs), frame(spark, items, "item_id long, text string")
    want = []
    for i, text in docs:
        for k, item in items:
            f, b = folded(text), folded(item)
            limit = decontaminate.budget(len(b))[0] if len(b) >= decontaminate.Q else 0
            if b and f and (e := fewest_edits(b, f)) <= limit:
                want.append((i, k, e))
    got = decontaminate.find_leaks(df, bench).collect()
    same([(x["doc_id"], x["item_id"], x["edits"]) for x in got], want)
    assert len({w[0] for w in want}) > 12
    bad = {w[0] for w in want}
    same([x["doc_id"] for x in decontaminate.drop_leaks(df, bench).collect()], [i for i, _ in docs if i not in bad])
    edge, rows = edge_docs(spark)
    assert decontaminate.find_leaks(edge, bench).count() == 0 and decontaminate.drop_leaks(edge, bench).count() == len(rows)
    assert decontaminate.find_leaks(edge.limit(0), bench).count() == 0 and decontaminate.find_leaks(edge, bench.limit(0)).count() == 0


def test_leaks_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 150)
    r = random.Random(6)
    items = [(k, prose(r, 10)) for k in range(6)]
    docs = frame(spark, [(k, "see " + t) for k, t in items])
    same([(x["doc_id"], x["item_id"]) for x in decontaminate.find_leaks(docs, frame(spark, items, "item_id long, text string")).collect()], [(k, k) for k, _ in items])


def test_periodic_texts(monkeypatch):
    """Items, periodic or not, in texts of random periods, against the edit distance; hits in small parts, periods always looked for."""
    monkeypatch.setattr(decontaminate, "DENSE", 0)
    monkeypatch.setattr(decontaminate, "HITS_AT_ONCE", 50)
    r, found = random.Random(31), 0
    for _ in range(25):
        units = ["".join(r.choice("ab-=") for _ in range(r.randint(1, 6))) for _ in range(2)]
        units.append(units[0] * 9 + "xyz")  # a period of periods
        items = [(k, (u * 40)[: r.randint(30, 50)]) for k, u in enumerate(units)] + [(5, prose(r, 6))]
        texts = []
        for _ in range(6):
            u = r.choice(units)
            t = list((u * 900)[: r.randint(300, 900)])
            for _ in range(r.randint(0, 3)):
                p = r.randrange(len(t))
                t[p : p + 1] = r.choice([[], ["q"], [t[p], "q"]])
            texts.append("".join(t) + r.choice(["", " " + items[3][1], r.choice(units) * 60]))
        texts += [texts[0]] * 3 + ["=" * 30] * 2  # equal texts one after another are no period
        index = decontaminate.Index(items)
        got = {(t, index.ids[i]): e for t, i, e, *_ in decontaminate.search(texts, index)}
        want = {}
        for t, text in enumerate(texts):
            for k, item in items:
                f, b = folded(text), folded(item)
                if (e := fewest_edits(b, f)) <= decontaminate.budget(len(b))[0]:
                    want[t, k] = e
        assert got == want
        assert {t for t, *_ in decontaminate.search(texts, index, once=True)} == {t for t, _ in want}
        found += len(want)
    assert found > 100


def test_periodic_texts_are_cheap():
    import time
    import tracemalloc

    index = decontaminate.Index([(1, "=-~" * 533), (2, "=-" * 800), (3, prose(random.Random(32), 30))], True)
    for text in ("=-~" * 333_333, "=-" * 500_000, ("=-~" * 100 + "xy z") * 3_300):
        began = time.process_time()
        got = {index.ids[i] for _, i, *_ in decontaminate.search([text], index)}
        assert got == {1 if "~" in text else 2} and time.process_time() - began < 10
        tracemalloc.start()
        assert list(index.bands(decontaminate.fold([text[:400_000]]))) and tracemalloc.get_traced_memory()[1] < 300 << 20
        tracemalloc.stop()


def test_ruled_lines_are_cheap(spark):
    import time

    line, words = "=" * 800, prose(random.Random(19), 30)
    index = decontaminate.Index([(1, "=" * 1500), (2, words + "\n" + line + "\n" + words), (3, words)], True)
    text = "x" + "=" * 1_000_000 + "\n" + words
    began = time.process_time()
    got = {index.ids[i]: e for _, i, e, *_ in decontaminate.search([text], index)}
    assert got == {1: 0, 2: 0, 3: 0} and time.process_time() - began < 10


def test_parts_of_items(spark, tmp_path):
    r = random.Random(15)
    item, line = prose(r, 60), prose(r, 11)
    long = folded(item)
    docs = [(1, "x " + long[100:195] + " y"), (2, long[:40]), (3, "a " + line + " b"), (4, item), (5, prose(r, 80)), (6, "z " + long[70:120] + "q" + long[120:170])]
    items = [(7, item), (8, "Short one.\n" + line + "\n" + prose(r, 30))]
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    frame(spark, items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(x["doc_id"], x["item_id"]): x for x in decontaminate.op2_benchmark_leaks(spark, str(tmp_path)).collect()}
    assert len(line) >= decontaminate.SEGMENT and set(got) == {(1, 7), (3, 8), (4, 7), (6, 7)}
    assert (got[4, 7]["begin"], got[4, 7]["end"]) == (0, len(long)) and got[1, 7]["edits"] == 0 and got[6, 7]["edits"] <= 1
    kept = corpus_pipeline.drop_contaminated(spark, frame(spark, docs), str(tmp_path)).collect()
    assert sorted(x["doc_id"] for x in kept) == [2, 5]


# ---- 3 ---------------------------------------------------------------------


def test_folding():
    assert toxicity.fold("1D10T! Ｉ,  sсum") == (" idiot i scum ", 3)


def toxic_rows(n=400, harmless=True):
    r = random.Random(7)
    out = []
    for i in range(n):
        words = prose(r, 30).split()
        bad = i % 5 == 0
        for _ in range(3 if bad else 0):
            words[r.randrange(30)] = r.choice(["vermin", "V3rm1n", "dolt"])
        if harmless and not bad and i % 17 == 1:
            words[4:6] = ["vermin", "control"]
        out.append((i, " ".join(words), int(bad)))
    return out


def test_toxicity(spark):
    rows = toxic_rows()
    docs = frame(spark, [r[:2] for r in rows])
    labels = frame(spark, [(r[0], None, r[2]) for r in rows] + [(None, 1, 1), (10**6, 0, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, train=lambda d: ~toxicity.held_out(d))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert len(held) > 60 and sum((got[i] >= toxicity.THRESHOLD) == bool(t) for i, _, t in held) >= 0.97 * len(held)
    assert toxicity.fold("vermin control")[0].strip() in model.exceptions  # learned: harmless although it holds an entry
    same([r["doc_id"] for r in toxicity.drop_toxic(docs, model).collect()], [i for i, s in got.items() if s < toxicity.THRESHOLD])
    edge, more = edge_docs(spark)
    assert toxicity.score(edge, model).count() == len(more) and toxicity.drop_toxic(edge, model).columns == edge.columns
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(edge, model).collect())


def test_labels_without_documents_take_no_place(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", 60)
    rows = toxic_rows()
    docs = frame(spark, [r[:2] for r in rows] + [rows[0][:2]] * 3)
    labels = [(r[0], None, r[2]) for r in rows]
    schema = "doc_id long, quality int, toxic int"
    one = toxicity.fit(docs, frame(spark, labels, schema))
    two = toxicity.fit(docs, frame(spark, labels + [(i, 1, i % 2) for i in range(1000, 9000)], schema))
    assert one.entries and one == two


def test_toxicity_without_labels(spark):
    docs = frame(spark, [(1, "a"), (2, None)])
    none = frame(spark, [], "doc_id long, quality int, toxic int")
    assert all(r["score"] < 0.3 for r in toxicity.score(docs, toxicity.fit(docs, none)).collect())


def test_toxicity_query_finds_held_out_labels(spark):
    """``op3_toxicity`` over whole tables: recall and false alarms on the labels that it never learned from."""
    sf = "/root/testdata/sf0.1"
    got = catalog.queries()["op3_toxicity"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").selectExpr("doc_id", "cast(toxic AS int) AS toxic")
    rows = got.where("held_out").join(labels, "doc_id").select("toxic", "predicted", "score").collect()
    toxic, clean = [r for r in rows if r["toxic"] == 1], [r for r in rows if r["toxic"] == 0]
    assert len(toxic) > 100 and len(clean) > 500
    assert sum(r["predicted"] for r in toxic) >= 0.9 * len(toxic)
    assert sum(r["predicted"] for r in clean) <= 0.03 * len(clean)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


# ---- 4 ---------------------------------------------------------------------


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(LOW), re.match(r"[^?#]*", rest[len(host) :])[0]


def brute_rule(host, path):
    fit = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def brute_llr(urls, counted=None):
    """The interpolated models by their definition, over distinct URLs (of which all are counted, or ``counted``)."""
    text = lambda u: re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", u).lower()
    n = url_filter.ORDER
    counts = {c: defaultdict(Counter) for c in ("allow", "block")}
    for u in urls if counted is None else counted:
        v = brute_rule(*brute_parts(u))[1]
        s = url_filter.START * n + text(u) + url_filter.END
        for i in range(n, len(s)):
            for k in range(n + 1):
                if v:
                    counts[v][s[i - k : i]][s[i]] += 1

    def p(c, context, char):
        below = p(c, context[1:], char) if context else 1 / url_filter.SYMBOLS
        seen = counts[c].get(context)
        return (seen[char] + len(seen) * below) / (sum(seen.values()) + len(seen)) if seen else below

    out = {}
    for u in urls:
        s = url_filter.START * n + text(u) + url_filter.END
        parts = [round((np.log(p("allow", s[i - n : i], s[i])) - np.log(p("block", s[i - n : i], s[i]))) * url_filter.UNIT) for i in range(n, len(s))]
        out[u] = sum(parts) / len(parts) / url_filter.UNIT
    return out


def test_urls(spark):
    urls = ["https://a.example.org/es/1", "http://Example.ORG/en/12", "https://b.example.org/en/2?x", "http://c.com/fr/1#y", "http://c.com/de/9", "https://d.net/x", "org", None, "", "://org/", "http://org/", "http://xorg/",
            "http://example.org", "http://q.com:80/fr/", "http://d.net/fr/?u=http://e.org/", "HTTP://D.NET/%"]
    rows = [(i, u, None) for i, u in enumerate(urls)] + [(0, urls[0], None), (None, "https://d.net/x", None)]
    df = frame(spark, rows, "page_id long, url string, rule string")
    got = url_filter.judge_urls(df).collect()
    assert len(got) == len(rows)
    distinct = {u or "" for _, u, _ in rows}
    scores, held = brute_llr(distinct), {}
    half = {u: xxhash.xxh64_intdigest(u.encode(), seed=42) % 2 for u in distinct}  # as Spark's xxhash64
    for k in (0, 1):
        held |= brute_llr({u for u in distinct if half[u] == k}, {u for u in distinct if half[u] != k})
    for r in got:
        url = urls[r["page_id"]] if r["page_id"] is not None else "https://d.net/x"
        host, path = brute_parts(url)
        rule, verdict = brute_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and (verdict is None or r["verdict"] == verdict)
        assert abs(r["score"] - scores[url or ""]) < 1e-5
        assert abs(r["held_score"] - held[url or ""]) < 1e-5 if verdict else r["held_score"] is None
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_held_out_urls(spark):
    """Models that never saw a ruled URL judge it as its rule does, by the threshold in use. (sf0.01 has too few URLs: README gives its figures.)"""
    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("the larger tables are not here")
    got = url_filter.op4_url_filter(spark, sf).where("rule is not null").select("verdict", "held_score", "threshold").collect()
    for verdict in ("allow", "block"):
        judged = [(r["held_score"] >= r["threshold"]) == (verdict == "allow") for r in got if r["verdict"] == verdict]
        assert len(judged) > 20 and sum(judged) >= 0.95 * len(judged)


def test_threshold():
    assert url_filter._threshold([(-3, 0, 5), (-1, 1, 4), (2, 6, 0)]) in range(0, 3) and url_filter._threshold([(4, 3, 0)]) == 0


# ---- 5 ---------------------------------------------------------------------


def test_audio(spark):
    docs, rows = edge_docs(spark)
    probed = audio.probe_audio(audio.with_audio(docs)).collect()
    for r in probed:
        assert r["payload"][: r["n_bytes"]] in {(t or "").encode() for _, t in rows} and len(r["payload"]) % 64 == 0 and len(r["payload"]) > 0
        assert r["samples"] == 1152 * len(r["frame_offsets"]) and r["crc_bad"] == 0 and r["resyncs"] == 0
    same([r["payload"][: r["n_bytes"]] for r in probed], [(t or "").encode() for _, t in rows])
    assert audio.with_audio(docs.limit(0)).count() == 0


def test_audio_query(spark, tmp_path):
    docs, rows = edge_docs(spark)
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        media = audio.write_mpeg(padded, len(raw))
        want.append((i, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), len(media), hashlib.sha256(media).hexdigest()))
    got = audio.op5_mpeg_audio(spark, str(tmp_path)).collect()
    same([tuple(r)[:7] for r in got], want)
    assert len({(r["media_sha256"], r["feature"]) for r in got}) == len({t or "" for _, t in rows})  # equal texts, equal values


def test_audio_damage():
    r = random.Random(8)
    payload = bytes(r.randrange(256) for _ in range(64 * 60))
    data = audio.write_mpeg(payload, 3800)
    whole = audio.read_mpeg(data)
    assert audio.payload_of(whole) == payload and whole.vbr_frames == len(whole.offsets) and whole.vbr_bytes == len(data) - 44
    assert [data[o : o + 2] for o in whole.offsets] == [b"\xff\xfa"] * len(whole.offsets)
    at = whole.offsets[1]
    for broken in (data[:at] + b"\xff\xfbjunk" + data[at:], b"noise" * 9 + data[10 + 51 :], data[: at + 400] + data[whole.offsets[2] :]):
        p = audio.read_mpeg(broken)
        assert p.resyncs >= 1 and len(p.offsets) >= len(whole.offsets) - 2
    bent = bytearray(data)
    bent[at + 7] ^= 1
    assert audio.read_mpeg(bytes(bent)).crc_bad == 1 and audio.payload_of(audio.read_mpeg(bytes(bent))) is None
    assert audio.read_mpeg(data + b"TAG" + bytes(125)).tags["ID3v1"][:3] == b"TAG"
    assert audio.read_mpeg(b"").offsets == [] and audio.read_mpeg(b"\xff" * 500).offsets == []
    h = audio.parse_header(bytes.fromhex("fffb9064"))  # 128 kbit/s, 44.1 kHz, joint stereo
    assert (h.kbps, h.rate, h.size, h.samples, h.mono) == (128, 44100, 417, 1152, False)


# ---- 6 ---------------------------------------------------------------------


def brute_lines(rows, percent=80):
    lines = [(i, k, frozenset(WORD.findall(x.translate(LOW)))) for i, t in rows if i is not None and t is not None for k, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if x[2]]
    return {(i, k) for i, k, s in lines if any((j, m) < (i, k) and 100 * len(s & t) >= percent * len(s | t) for j, m, t in lines)}


@pytest.mark.parametrize("hot", [2048, 0])
def test_lines(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    monkeypatch.setattr(line_dedup, "SPLIT", min(hot, line_dedup.SPLIT))
    r = random.Random(9)
    pool = [prose(r, r.choice([3, 6, 12, 40])) for _ in range(40)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(r.randint(0, 6)):
            w = r.choice(pool).split()
            for _ in range(r.randint(0, 2)):
                w[r.randrange(len(w))] = "e" + str(r.randint(0, 3))
            lines.append(" ".join(w))
        rows.append((i, "\n".join(lines)))
    gone = brute_lines(rows)
    got = {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows} and len(gone) > 30


def test_lines_of_one_first_signature(spark, monkeypatch):
    """Unlike sets that share the half of the signature by which candidates travel are still told apart and compared."""
    monkeypatch.setattr(line_dedup, "FIRST", 7)
    for hot in (2048, 0):
        test_lines(spark, monkeypatch, hot)


def test_near_copies_make_few_candidates(spark, monkeypatch):
    """Near copies of a line that is not there, each similar to a few of the others: candidates grow with the lines, not with their square."""
    monkeypatch.setattr(line_dedup, "HOT", 50)
    made, linked = [], line_dedup._Groups.linked
    monkeypatch.setattr(line_dedup._Groups, "linked", lambda self, pairs: (made.append(pairs.count()), linked(self, pairs))[1])
    r, rows = random.Random(31), []
    for i in range(400):
        w = [f"word{k}" for k in range(28)]
        for k, at in enumerate(r.sample(range(28), 2)):
            w[at] = f"own{i}x{k}"
        rows.append((i, " ".join(w)))
    gone = brute_lines(rows)
    got = {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got == {i: "" if (i, 0) in gone else t for i, t in rows} and len(gone) > 350
    assert sum(made[1:]) < 20 * len(rows), made


def test_only_crowded_lines_are_split(spark, monkeypatch):
    """Lines that share a word with near copies of another, and are near nothing, stay out of what is split."""
    split, made = line_dedup._Groups.split, []
    monkeypatch.setattr(line_dedup._Groups, "split", lambda self, state, depth: (made.append(state.count()), split(self, state, depth))[1])
    rows = [(i, f"own{i} hub " + " ".join(f"word{k} " * 6 for k in range(18))) for i in range(60)]
    rows += [(i, "hub " + " ".join(f"lone{i}x{k} " * 300 for k in range(4))) for i in range(60, 260)]
    got = {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got == {i: "" if 0 < i < 60 else t for i, t in rows}
    assert sum(made) < 100, made


def test_close_gives_or_holds_every_pair():
    """Each pair that passes the filters is given, or both of its lines are held under its key; few are given for each member."""
    r = np.random.default_rng(4)
    key, n = np.sort(r.integers(0, 4, 500)), r.integers(8, 12, 500)
    key[key == 3] = np.arange(int((key == 3).sum())) // 3 + 3
    pos, a = r.integers(0, 3, 500), np.arange(500) + 1000
    bits = np.where(r.random(500) < 0.5, 0, r.integers(0, 1 << 62, 500))  # half of them near each other, half near none
    found, keys, held = line_dedup._close(key, a, n, pos, bits, 80, chunk=100)
    given, crowded = {tuple(x) for x in found.tolist()}, set(zip(keys.tolist(), held.tolist(), strict=True))
    for i in range(500):
        for j in range(i + 1, 500):
            size = int(n[i] + n[j])
            near = int(bits[i] ^ bits[j]).bit_count() * 180 <= size * 20 and min(n[i], n[j]) * 100 >= max(n[i], n[j]) * 80 and min(n[i] - pos[i], n[j] - pos[j]) * 180 >= size * 80
            if key[i] == key[j] and near:
                assert (a[i], a[j]) in given or {(key[i], a[i]), (key[i], a[j])} <= crowded
            else:
                assert (a[i], a[j]) not in given
    assert 30 < len(crowded) < 300 and len(given) <= 4 * 500


def test_two_texts_under_one_id(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(12)) for c in "ab")
    rows = [(1, a), (1, b), (1, a + " more"), (2, b + " end"), (3, "other words " + a), (4, "lone line of its own")]
    got = sorted((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(frame(spark, rows)).collect())
    assert got == sorted([(1, a), (1, b), (1, a + " more"), (2, ""), (3, ""), (4, "lone line of its own")])


def test_lines_edges(spark):
    docs, rows = edge_docs(spark)
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [c for c in docs.columns if c != "lines_removed"] + ["lines_removed"]
    got = {(r["doc_id"], r["text"]) for r in out.collect()}
    assert out.count() == len(rows) and (None, "no id") in got and (0, None) in got and (7, "") in got  # 7 repeats 6
    assert (7, "") not in {(r["doc_id"], r["text"]) for r in line_dedup.drop_emptied(out).collect()}
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [2048, 0])
def test_short_lines(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    monkeypatch.setattr(line_dedup, "SPLIT", min(hot, line_dedup.SPLIT))
    r = random.Random(14)
    rows = [(i, "\n".join(" ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 9))) for _ in range(r.randint(0, 6)))) for i in range(50)]
    rows += [(60, "a b c d"), (61, "a b c d X"), (62, "漢字だけの行\n"), (63, "漢字だけの行\n漢字"), (64, "W x y z v\nx w z Y\nx w z")]
    gone = brute_lines(rows)
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    assert {x["doc_id"]: x["text"] for x in line_dedup.op6_line_dedup(spark, str(tmp_path)).collect()} == want
    assert {(61, 0), (63, 0), (64, 1)} <= gone and (64, 2) not in gone and len(gone) > 60


def test_only_emptied_documents_go(spark):
    shared = "a licence line that every document here ends with"
    rows = [(1, "one two\n" + shared), (2, "first short line\nsecond\n" + shared), (3, "漢字だけの行\n" + shared), (4, shared), (5, " \t\r\n" + shared + "\n\x0b\x0c"), (6, ""), (7, None)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_emptied(line_dedup.dedup_lines(frame(spark, rows))).collect()}
    assert got == {1: rows[0][1], 2: "first short line\nsecond", 3: "漢字だけの行", 6: "", 7: None}


# ---- 7 ---------------------------------------------------------------------


def test_bpe(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs, rows = edge_docs(spark)
    got = bpe.bpe_digests(docs, BPE, public_tokenizers.PATTERN).collect()
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), digest(np.array(ids, "<u4").tobytes()), digest((t or "").encode())))
    same([tuple(r) for r in got], want)
    assert bpe.bpe_encode(docs.limit(0), BPE, public_tokenizers.PATTERN).count() == 0


def test_a_task_that_puts_ids_together_decodes_them_too(spark):
    docs, _ = edge_docs(spark)
    made = bpe.bpe_digests(docs, BPE, public_tokenizers.PATTERN, block_bytes=64)
    nodes = re.findall(r"\w*InArrow\w*", made._jdf.queryExecution().sparkPlan().toString())
    assert nodes[0] == "FlatMapCoGroupsInArrow" and nodes.count("MapInArrow") == 3  # a decoder on top was a second worker in each task
    one = bpe.bpe_round_trip(docs, BPE, public_tokenizers.PATTERN, 64).collect()
    two = bpe.bpe_decode(bpe.bpe_encode(docs, BPE, public_tokenizers.PATTERN), BPE).collect()
    same([tuple(r) for r in one], [tuple(r) for r in two])


def test_the_table_of_coded_ids_is_made_at_once(monkeypatch):
    calls = []
    monkeypatch.setattr(bpe, "varint", lambda v: calls.append(len(v)) or arrow.varint(v))
    for n in (0, 1, 129, 16_400):
        bpe._coded_ids.cache_clear()
        assert bpe._coded_ids(n) == [arrow.varint(np.array([i])) for i in range(n)]
    bpe._coded_ids.cache_clear()
    assert calls == [0, 1, 129, 16_400]  # one call an id took 2.9 s in every task


def test_packing():
    r = random.Random(10)
    v = np.array([r.choice([0, 1, 127, 128, 16383, 16384, 2**31]) for _ in range(500)])
    assert (arrow.unvarint(arrow.varint(v)) == v).all() and bpe._split(bpe._join([b"", b"ab", b"c" * 300])) == [b"", b"ab", b"c" * 300] and bpe._split(bpe._join([])) == []
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 5, None, "b" * 20, "", "c"]})
    assert [len(x) for x in arrow.by_bytes([batch], "text", 10)] == [2, 1, 2]


# ---- 8 ---------------------------------------------------------------------


def test_token_counts(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs, rows = edge_docs(spark)
    want = [(i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for i, t in rows]
    same([tuple(r) for r in token_counts.token_counts(docs, PIECES).collect()], want)
    assert token_counts.token_counts(docs.limit(0), PIECES).count() == 0
    maps, r = token_counts.load(PIECES), random.Random(11)
    letters = list("aeinorstdlu   \n\t.,0'") + list("é日👍▁ﬁ")
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    assert token_counts.count_texts(texts, maps).tolist() == [len(x) for x in sp.encode(texts)]


# ---- 9 ---------------------------------------------------------------------


def test_warc(spark):
    r = random.Random(12)
    rows = [(i, f"https://h.example/{i}", r.choice(["", None, "<p>é</p>", "x" * 100_000, f"<p>{i} {prose(r, 20)}</p>"])) for i in range(1, 120)]
    rows += [(200, None, "only"), (201, "bad url\r\nX: y", "z"), (None, "u", "<p>é</p>"), (5, "again", rows[4][2])]
    pages = frame(spark, rows, "page_id long, url string, html string")
    archives = warc.write_archives(warc.with_revisits(pages)).collect()
    assert all(a["bytes"][:4] == b"\x5d\x2a\x4d\x18" for a in archives) and sum(a["n_records"] for a in archives) == len(rows)
    got = [x for a in archives for x in warc.read_archive(bytes(a["bytes"]))]
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, u, h in rows:
        b = (h or "").encode()
        later = i is not None and i > first[h or ""]
        want.append((i, "bad%20url%0D%0AX:%20y" if i == 201 else u, "revisit" if later else "response", first[h or ""] if later else None, base64.b32encode(hashlib.sha1(b).digest()).decode(), len(b), None if later else b))
    same(got, want)
    assert warc.write_archives(warc.with_revisits(pages.limit(0))).count() == 0


@pytest.mark.parametrize("name, table", [("op9_warc", "pages"), ("op10_feistel_shards", "documents")])
def test_queries_equal_their_sql_on_edge_rows(spark, tmp_path, name, table):
    docs, rows = edge_docs(spark)
    pages = frame(spark, [(i, None, t) for i, t in rows], "page_id long, url string, html string")
    for k, df in enumerate([pages if table == "pages" else docs, (pages if table == "pages" else docs).limit(0)]):
        df.coalesce(1).write.parquet(f"{tmp_path}/{k}/{table}.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{k}/{table}.parquet/*.parquet'")
        want = con.execute(catalog.oracle_sql()[name])
        names = [d[0] for d in want.description]
        got = catalog.queries()[name](spark, f"{tmp_path}/{k}").select(*names).collect()
        same([tuple(x) for x in got], want.fetchall())
        assert len(got) == (0 if k else len(rows))


# ---- 10 --------------------------------------------------------------------


def test_shards(spark):
    docs, rows = edge_docs(spark)
    got = sharding.feistel_shards(spark, docs, 7).collect()
    assert sorted(r["row_no"] for r in got) == list(range(len(rows)))
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n)) for s, n in sizes.items())
    same([(r["doc_id"], r["size"], r["text_crc32"]) for r in got], [(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows])
    assert all(r["law"] == "rows" and r["grown_shard"] is None for r in got)
    again = sharding.feistel_shards(spark, docs.repartition(3), 7).collect()
    same([(r["row_no"], r["shard"], r["slot"]) for r in got], [(r["row_no"], r["shard"], r["slot"]) for r in again])
    assert sharding.feistel_shards(spark, docs.limit(0), 7).count() == 0


def brute_permuted(x, n, key):
    a, b = sharding.sides(n)
    while True:
        left, right = divmod(x, b)
        for r in range(sharding.ROUNDS):
            f = lambda half: int(hashlib.md5(f"{key}:{r}:{half}".encode()).hexdigest()[:12], 16)  # noqa: B023, E731
            left, right = (left, (right + f(left)) % b) if r % 2 else ((left + f(right)) % a, right)
        x = left * b + right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 40, 997])
def test_permutation(spark, n):
    from pyspark.sql import functions as F

    got = [r[0] for r in spark.range(n).orderBy("id").select(sharding.permuted(F.col("id"), n, 5)).collect()]
    assert got == [brute_permuted(x, n, 5) for x in range(n)] and sorted(got) == list(range(n))


# ---- the pipeline ----------------------------------------------------------


def test_pipeline(spark, tmp_path):
    r = random.Random(13)
    leak = prose(r, 14)
    passage = prose(r, 60)
    rows = [(i, t + "\n" + prose(r, 40)) for i, t, _ in toxic_rows(200, False)]
    rows += [(300, passage + "\n" + prose(r, 50)), (301, prose(r, 50) + "\n" + passage), (302, rows[1][1]), (303, "note " + leak + " end"), (304, ""), (305, None)]
    copy = prose(r, 80).split()
    rows += [(310, " ".join(copy)), (311, " ".join(copy[:40] + ["edit"] + copy[41:]))]
    docs = frame(spark, [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    frame(spark, [(i, 1, t) for i, _, t in toxic_rows(200, False)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame(spark, [(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {x["doc_id"]: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    toxic = {i for i, _, t in toxic_rows(200, False) if t}
    assert not toxic & set(out) and not {302, 303, 311} & set(out) and {300, 301, 304, 305, 310} <= set(out)
    assert len(out) == len(rows) - len(toxic) - 3
    clean = dict(rows)
    assert out[300]["decoded_sha256"] == hashlib.sha256(clean[300].encode()).hexdigest()
    assert out[301]["decoded_sha256"] == hashlib.sha256(clean[301].split("\n")[0].encode()).hexdigest()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "byte_level_bpe"]


def test_wide_maps_never_overstate():
    r = random.Random(15)
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(r.sample(words, r.randint(1, 120))) for _ in range(60)] + ["", None, "w1", "w1 w1"]
    x = line_dedup._Lines(pa.array(texts))
    maps = np.array(x.wide()).T.view(np.uint64)
    sets = [set(x.flat[s : s + n].tolist()) for s, n in zip(x.starts.tolist(), x.n.tolist(), strict=True)]
    assert len(sets) == 62 and (maps[-1] == maps[-2]).all()
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert int(np.bitwise_count(maps[i] ^ maps[j]).sum()) <= len(a ^ b)
    assert [len(c) for c in line_dedup._Lines(pa.array(["", None])).wide()] == [0] * len(line_dedup.WIDE)
