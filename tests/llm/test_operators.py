"""Text operators against brute force on small tables with nulls, empty texts, ties, repeats and clashing names."""

import base64
import hashlib
import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest

from lumenframe.llm import bpe, fingerprints, langid, line_dedup, mixing, near_dedup, suffix_dedup, topk, toxicity, warc
from lumenframe.llm.common import components, fresh_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, h string, key string"


def prose(rng, n):
    return " ".join("".join(rng.choice(["the", "on", "er", "ti", "an", "re", "éa", "ß"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    base = [prose(rng, rng.randint(30, 120)) for _ in range(30)]
    passage = prose(rng, 60)
    out = [None, "", "   ", "\n\n", "one", "two words", "one", "a b c d", "Of " * 200, "Of " * 200, "x" * 300, "é" * 130]
    for t in base:
        out.append(t)
        words = t.split(" ")
        words[len(words) // 2] = "changed"
        out += [t, " ".join(words), t[: len(t) // 2] + passage + t[len(t) // 2 :], t.upper() + "\n" + base[0]]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, ["en", "de", None][i % 3], ["s1", "s2", "", None][i % 4], len(t or ""), i, "h", "k") for i, t in enumerate(texts)], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_composition_is_nfc(spark):
    given = ["Å", "é é q̣̇ q̣̇", "각", "à֮̕b", "̈́", "ΐ", "plain"]
    got = spark.createDataFrame([(x,) for x in given], "text string").select("text", fingerprints.composed(fingerprints.F.col("text")).alias("c")).collect()
    assert all(r["c"] == unicodedata.normalize("NFC", r["text"]) for r in got)


def test_fingerprints(docs, texts, empty):
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_report(docs).collect()}
    order = sorted(range(len(texts)), reverse=True)
    for i, d in enumerate(order):
        t, x = texts[d] or "", texts[order[(i + 1) % len(order)]] or ""
        edited = t[: len(t) - len(t) // 2] + x[: len(t) // 2]
        assert got[d]["n_chars"] == len(t)
        assert got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        if edited == t:
            assert got[d]["near_edited"] == 1 and got[d]["fingerprint"] == got[d]["edited_fingerprint"]
    same = {}
    for d, t in enumerate(texts):
        same.setdefault(" ".join((t or "").upper().lower().split()), set()).add(got[d]["fingerprint"])
    assert all(len(v) == 1 for v in same.values()) and len({min(v) for v in same.values()}) == len(same)
    assert fingerprints.fingerprint_report(empty).count() == 0
    assert fingerprints.fingerprints(docs).select("fingerprint").distinct().count() == len(same)


def test_bpe_is_the_library(docs, texts, empty):
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    lib = Tokenizer.from_file(path)
    got = {r["doc_id"]: r for r in bpe.encode_documents(docs, path).collect()}
    for d, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[d]["ids"] == ids and got[d]["n_tokens"] == len(ids)
        assert got[d]["decoded"] == lib.decode(ids, skip_special_tokens=False)
    assert bpe.encode_documents(empty, path).count() == 0
    model, rng = bpe.model(open(path, 'rb').read()), random.Random(3)
    for _ in range(3000):
        s = "".join(rng.choice("aAbéÉßİΣσςſK'stllved 12½²٣\n\t ́ǅ😀漢字<|>_-ﬁ\x85\x1c") for _ in range(rng.randint(0, 14)))
        s += "<|endoftext|>" * rng.randint(0, 1)
        ids = lib.encode(s, add_special_tokens=False).ids
        assert model.encode(s) == ids and model.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    assert model.encode("ab" * 50_000) == lib.encode("ab" * 50_000, add_special_tokens=False).ids


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(1, "http://a/1", "<p>é</p>", "z"), (2, "http://a/2", "<p>é</p>", "z"), (3, None, None, "z"), (4, "u", "", "z"), (5, "u", "\r\n\r\nWARC/1.1", "z"), (5, "u", "\r\n\r\nWARC/1.1", "z"), (None, "u", "n", "z")], "page_id long, url string, html string, digest string")
    path = fresh_path(spark, "test")
    warc.write_archive(pages, path)
    records = warc.read_archive(spark, path)
    got = {(r["page_id"], r["record_type"]): r for r in records.collect()}
    assert records.count() == 7 and spark.read.parquet(f"{path}/payloads").count() == 4
    assert got[1, "revisit"]["refers_to"] == 2 and got[3, "revisit"]["refers_to"] == 4 and got[5, "revisit"]["refers_to"] == 5
    assert got[2, "response"]["payload_digest"] == base64.b32encode(hashlib.sha1("<p>é</p>".encode()).digest()).decode()
    assert bytes(got[5, "response"]["payload"]).decode() == "\r\n\r\nWARC/1.1"
    warc.export_warc(records, f"{path}/files")
    back = warc.read_warc(spark, f"{path}/files").collect()
    assert sorted((r["record_type"], r["header"]) for r in back) == sorted((r["record_type"], r["header"]) for r in records.collect())
    assert sorted(bytes(r["payload"]) for r in back if r["record_type"] == "response") == sorted(bytes(r["payload"]) for r in records.collect() if r["record_type"] == "response")


def test_langid(spark, sf, empty):
    rows = langid.predict(spark.read.parquet(f"{sf}/documents.parquet")).where("held_out").select("lang", "lang_pred", "score").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97 and all(0 <= r["score"] <= 1 for r in rows)
    odd = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "123 !?", "en"), (4, "the", "en"), (None, "the the", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.classify(odd, langid.train(odd)).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4)] == ["und", "und", "und", "en"] and got[1]["score"] == 0
    assert langid.predict(empty).count() == 0


def folded(x):
    """Lower case, one character for one."""
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in x)


def test_line_dedup_against_all_pairs(docs, texts, empty):
    def shingles(s):
        return {s} if len(s) < 5 else {s[i : i + 5] for i in range(len(s) - 4)}

    places = [(d, p, folded(line.strip())) for d, t in enumerate(texts) if t is not None for p, line in enumerate(t.split("\n"))]
    unique = sorted({x for _, _, x in places if x})
    sets, group = [shingles(x) for x in unique], {x: x for x in unique}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, x in enumerate(unique):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                group[find(x)] = find(unique[j])
    seen, kept = set(), {}
    for d, _, x in sorted(places, key=lambda p: p[:2]):
        root = find(x) if x else None
        if x and root in seen:
            continue
        seen.add(root)
        kept[d] = kept.get(d, 0) + 1
    got = {r["doc_id"]: r for r in line_dedup.deduplicate(docs).collect()}
    assert got[0]["text"] is None and got[0]["n_lines"] == 0
    right = sum(got[d]["n_lines"] - got[d]["n_removed"] == kept.get(d, 0) for d in range(1, len(texts)))
    # min-hash bands may miss a pair near the threshold; they never join lines that are apart
    assert right >= 0.98 * (len(texts) - 1)
    assert line_dedup.deduplicate(empty).count() == 0


def line_sets(x):
    return {x} if len(x) < 5 else {x[i : i + 5] for i in range(len(x) - 4)}


def alike(x, y):
    x, y = line_sets(x), line_sets(y)
    return 100 * len(x & y) >= 80 * len(x | y)


def pair_frame(spark, pairs):
    return spark.createDataFrame([(2 * i + k, x) for i, p in enumerate(pairs) for k, x in enumerate(p)], "doc_id long, text string").repartition(8)


def test_line_dedup_of_few_words(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 12)))
    pairs = [("Subscribe to newsletter!", "Subscribe to newsletter."), ("-" * 12, "-" * 90)]
    for n in (2, 3, 4, 5, 6, 8, 12, 20):
        for _ in range(150):
            x = " ".join(word() for _ in range(n))
            at = rng.choice([len(x) - 1, rng.randrange(len(x))])
            y = x[:at] + "#" + x[at + 1 :]
            pairs += [(x, y)] * alike(x, y)
    gone = {r["doc_id"] for r in line_dedup.deduplicate(pair_frame(spark, pairs)).where("n_removed = 1").collect()}
    assert all(d % 2 for d in gone) and {1, 3} <= gone
    # of up to 60 shingles none may be missed
    missed = [p for i, p in enumerate(pairs) if 2 * i + 1 not in gone]
    assert not [p for p in missed if len(p[0]) <= 64] and len(missed) <= 0.002 * len(pairs)


def test_line_dedup_in_large_buckets(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 9)))
    pairs = []
    for fixed, free in ((14, 2), (5, 1)):
        template = [word() for _ in range(fixed)]
        for _ in range(100):
            words, own = list(template), [word() for _ in range(free)]
            for w in own:
                words.insert(rng.randrange(len(words) + 1), w)
            x = " ".join(words)
            pairs += [(x, x.replace(own[0], own[0] + "s"))]
    pairs = [p for p in pairs if alike(*p)]
    rng.shuffle(pairs)
    every = [x for p in pairs for x in p]
    sets, group = [line_sets(x) for x in every], list(range(len(every)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            k = len(x & sets[j])
            if 100 * k >= 80 * (len(x) + len(sets[j]) - k):
                a, b = sorted((find(i), find(j)))
                group[b] = a
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.deduplicate(pair_frame(spark, pairs)).collect()}
    assert len(pairs) > 100 and got == {i: int(find(i) != i) for i in range(len(every))}


def test_line_dedup_trims_all_white_space(spark):
    given = ["one line of text\r\n\r\nother words here\r", "\tone line of text\n\t\n\u3000\n\r\nother words here"]
    frame = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_dedup.deduplicate(frame).collect()}
    assert [got[i]["n_removed"] for i in (0, 1)] == [0, 2]
    assert got[0]["text"] == given[0] and got[1]["text"] == "\t\n\u3000\n\r"


def test_mixing(docs, texts, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(texts) and got == mixing.mix(docs.repartition(3)).collect()
    assert [r["position"] for r in got] == sorted(r["position"] for r in got)
    by, total = {}, sum(r["size"] for r in got)
    for r in got:
        assert r["size"] == len((texts[r["doc_id"]] or "").split()) and 0 <= r["taken"] <= 2 * r["size"]
        s = by.setdefault(["s1", "s2", "", None][r["doc_id"] % 4], [0, 0, r["target"], r["source_size"]])
        s[0] += r["size"]
        s[1] += r["taken"]
    assert all(s[0] == s[3] and abs(s[1] - s[2]) <= 1 for s in by.values())
    weights, open_, want, left = dict(zip(["", "s1", "s2", None], (3, 1, 2, 3), strict=True)), {*by}, {}, 1.5 * total
    while open_:
        level = left / sum(weights[k] for k in open_)
        full = {k for k in open_ if level * weights[k] > 2 * by[k][0]}
        for k in full or set(open_):
            want[k] = 2 * by[k][0] if full else level * weights[k]
            left -= want[k] if full else 0
        open_ -= full or set(open_)
    assert all(abs(want[k] - by[k][2]) < 1e-6 for k in by)
    assert mixing.mix(empty).count() == 0


def test_every_copy_has_its_own_time(spark):
    import corpus_pipeline

    rows = [(i, f"d{i} " * (1 + i % 7), s) for s, n in (("a", 40), ("b", 200), ("c", 30)) for i in range(n)]
    docs = spark.createDataFrame([(1000 * ord(s) + i, t, s) for i, t, s in rows], "doc_id long, text string, source string").repartition(4)
    first = {r["doc_id"]: r for r in mixing.mix(docs, ("source",)).collect()}
    got = mixing.copies(docs, ("source",)).collect()
    assert [r["position"] for r in got] == sorted(r["position"] for r in got)
    seen = {}
    for r in got:
        seen.setdefault(r["doc_id"], []).append((r["copy"], r["position"]))
    assert {d: len(v) for d, v in seen.items()} == {d: -(-r["taken"] // r["size"]) for d, r in first.items() if r["taken"]}
    order = {k: i for i, k in enumerate("abc")}
    assert any(len(v) > 1 for v in seen.values())
    for d, v in seen.items():
        r = first[d]
        kind = order[r["source"]] % 3
        start = {0: lambda p: p, 1: lambda p: p * p, 2: lambda p: 1 - (1 - p) ** 2}[kind](r["position"]) * r["target"]
        for c, position in v:
            part = min(1.0, (start + c * r["source_size"]) / r["target"])
            assert abs(position - {0: part, 1: part**0.5, 2: 1 - max(0.0, 1 - part) ** 0.5}[kind]) < 1e-6
    staged = [r["doc_id"] for r in corpus_pipeline.mixed(spark, docs, "").collect()]
    assert staged == [r["doc_id"] for r in got]


def test_toxicity(spark, empty):
    rng = random.Random(1)
    rows = [(i, prose(rng, 40) + (" horrid" if i % 9 == 0 else ""), None) for i in range(900)] + [(900, None, None), (901, "", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 9 == 0)) for i in range(0, 900, 2)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(frame, toxicity.train(frame, labels)).collect()}
    assert all(got[i]["predicted"] == int(i % 9 == 0) for i in range(900))
    assert got[900]["score"] == got[901]["score"] < 0.5
    assert toxicity.score(empty, toxicity.train(empty, labels.limit(0))).count() == 0


@pytest.mark.parametrize("limit", [4096, 2])
def test_suffix_dedup_against_brute_force(docs, texts, empty, limit, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SORTED", limit)
    got = {r["doc_id"]: r for r in suffix_dedup.deduplicate(docs).collect()}
    seen = set()
    for d, t in enumerate(texts):
        b = (t or "").encode()
        mark = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            mark[s : s + 100] |= w in seen
            seen.add(w)
        spans = int((mark & ~np.append(False, mark)[:-1]).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~mark])
        assert (got[d]["n_bytes"], got[d]["n_removed"], got[d]["n_spans"], got[d]["kept_sha256"]) == (len(b), mark.sum(), spans, hashlib.sha256(kept).hexdigest())
    assert suffix_dedup.deduplicate(empty).count() == 0


def test_near_dedup_against_all_pairs(docs, texts, empty):
    sets = []
    for t in texts:
        w = (t or "").split()
        w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in w]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * k >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs).collect()}
    for d in range(len(texts)):
        assert (got[d]["n_shingles"], got[d]["component_id"], got[d]["kept"]) == (len(sets[d]), find(d), find(d) == d)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_dedup_in_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 40)
    rng = random.Random(9)
    template = [f"t{i}" for i in range(174)]
    texts = []
    for i in range(75):
        tail = [f"p{i}x{k}" for k in range(5)]
        texts += [" ".join(template + tail + [f"q{i}y{c}z{k}" for k in range(25)]) for c in (0, 1)]
    order = rng.sample(range(len(texts)), len(texts))
    frame = spark.createDataFrame([(order[i], t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame).collect()}
    assert got == {order[i]: min(order[i], order[i ^ 1]) for i in range(len(texts))}


def test_mixed_rows_without_or_with_repeated_ids(spark):
    import corpus_pipeline

    rows = [(None, "a b c", "s"), (1, "one two", "s"), (1, "three four five", "t"), (2, "", "t"), (None, "x", None)] + [(i, "w " * 9, "u") for i in range(3, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    key = lambda r: (r["doc_id"], r["text"], r["source"])
    want = {}
    for r in mixing.mix(docs, ("text", "source")).collect():
        if r["taken"]:
            want[key(r)] = -(-r["taken"] // r["size"])
    got = {}
    for r in corpus_pipeline.mixed(spark, docs, "").collect():
        got[key(r)] = got.get(key(r), 0) + 1
    assert got == want and (None, "a b c", "s") in got and (2, "", "t") not in got


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(5)
    vectors = [[float(x) for x in rng.normal(size=16)] for _ in range(300)]
    vectors[7] = vectors[8]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(300, None), (320, [float("nan")] * 16), (340, [None] + [0.0] * 15), (301, [1.0] * 3)]
    frame = spark.createDataFrame(rows, "vec_id long, e array<float>").select("vec_id", topk.quantised(topk.F.col("e")).alias("v"))
    got = topk.top_k(frame, frame.where("vec_id % 20 = 0"), 20).collect()
    q = np.floor(np.array(vectors, np.float32).astype(float) * 64).astype(int)
    for i in range(0, 300, 20):
        s = q @ q[i]
        want = sorted((-s[j], j) for j in range(300) if j != i)[:20]
        assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == i) == [(k + 1, j, -x) for k, (x, j) in enumerate(want)]
    assert len(got) == 15 * 20
    assert topk.top_k(frame.limit(0), frame.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(None, 1), (5, 5)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}
    for a, b in edges:
        if a is not None and a != b:
            for x in (a, b):
                parent.setdefault(x, x)
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            parent[max(a, b)] = min(a, b)

    def find(x):
        return x if parent[x] == x else find(parent[x])

    assert got == {x: find(x) for x in parent}


def test_lines_lose_their_outer_white_space():
    rng = random.Random(12)
    space = [chr(c) for c in range(0x3001) if chr(c).isspace() and c != 10]
    given = [" " * n + "x 　y" + "　" * n + "\n" + "\xa0" * n for n in (0, 1, 64, 65, 300)]
    given += ["".join(rng.choice([*space, "a", "é", "、", "\n"]) for _ in range(rng.randint(0, 12))) for _ in range(500)]
    got = [(a + r, p, bytes(raw[s:e]).decode()) for a, raw, *each, _ in line_dedup.lines(pa.array(given)) for r, p, s, e in zip(*each, strict=True)]
    assert got == [(i, p, x.strip()) for i, t in enumerate(given) for p, x in enumerate(t.split("\n")) if x.strip()]


def test_line_dedup_runs_no_python(spark, monkeypatch):
    plans, stored = [], line_dedup.stored

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, name)

    monkeypatch.setattr(line_dedup, "stored", seen)
    kept = line_dedup.deduplicate(pair_frame(spark, [("a line that is here twice", "a line that is here twice!")]))
    plans.append(kept._jdf.queryExecution().executedPlan().toString())
    assert not [p for p in plans if "Arrow" in p or "Python" in p or "Pandas" in p]
    assert [r["n_removed"] for r in kept.orderBy("doc_id").collect()] == [0, 1]


def test_line_dedup_of_few_shingles_and_wide_characters(spark):
    rng = random.Random(14)
    long_ = "".join(rng.choice("😀😁x😂y é") for _ in range(300)) + "."
    same = [("-" * 12, "-" * 900), ("ab" * 30, "ab" * 200 + "a"), ("one two three four. " * 4, "one two three four. " * 30), (long_, long_[:-1] + "!"), ("😀😁😂😃😄" * 3, "😀😁😂😃😄" * 40), ("ΑΣ ΟΔΟΣ İ", "ασ οδοσ i")]
    apart = [("-" * 4, "-" * 3), ("😀" * 4, "😁" * 4), (long_[:150] + "".join(rng.choice("abcdefgh") for _ in range(150)), long_[5:100])]
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.deduplicate(pair_frame(spark, same + apart)).collect()}
    assert got == {i: int(i % 2 and i < 2 * len(same)) for i in range(2 * len(same + apart))}


def test_native_lines_are_those_of_arrow(spark):
    rng = random.Random(13)
    space = [chr(c) for c in range(0x3001) if chr(c).isspace() and c != 10]
    given = ["".join(rng.choice([*space, "a", "É", "、", "😀", "Σ", "\n"]) for _ in range(rng.randint(0, 12))) for _ in range(300)] + ["", None]
    frame = spark.createDataFrame(list(enumerate(given)), "doc long, text string")
    want = [(a + r, p, bytes(raw[s:e]).decode()) for a, raw, *each, _ in line_dedup.lines(pa.array(given)) for r, p, s, e in zip(*each, strict=True)]
    assert sorted((r["doc"], r["pos"], r["norm"]) for r in line_dedup.placed_lines(frame).collect()) == sorted(want)
