"""Every stage of the pipeline, and operators at their edges: nulls, empty and long texts, repeats, clashing names, empty tables."""

import base64
import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from lumenframe.llm import bpe, fingerprints, langid, line_dedup, mixing, near_dedup, suffix_dedup, topk, toxicity, warc
from lumenframe.llm.common import fresh_path

CLASHING = ["doc", "id", "key", "row", "gone", "n_lines", "score", "lang_pred", "component", "_a", "h", "position"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def prose(rng, n):
    return " ".join("".join(rng.choice(["the", "on", "er", "ti", "an", "re", "éa", "ß"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def rows_of(texts, ids):
    return [(i, t, "en", ["s", "t", None][k % 3], len(t or ""), *CLASHING) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(11)
    base = prose(rng, 60)
    long_ = "\n".join(prose(rng, 300) for _ in range(40)) + "\n" + "w" * 400_000
    texts = [None, "", " \n ", "123", base, base, base + " more", base, long_, long_ + " end", "Short line\nshort LINE\r\nother thing", *(prose(rng, 50) for _ in range(12))]
    ids = [None, 1, 2, 3, 4, 5, 6, 4, 8, 9, None, *range(20, 32)]
    return spark.createDataFrame(rows_of(texts, ids), SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_at_their_edges(spark, odd, empty, name):
    stage, last = dict(corpus_pipeline.STAGES)[name], corpus_pipeline.STAGES[-1][0]
    got = stage(spark, odd, "")
    given, found = odd.collect(), got.collect()
    if name != last:
        assert got.columns == odd.columns and all(r[c] == c for r in found for c in CLASHING)
    assert stage(spark, empty, "").count() == 0
    count = lambda rows: sorted((str(r["doc_id"]), r["text"] or "") for r in rows)
    if name == "language":
        assert count(found) == count(r for r in given if r["text"] and any(c.isalpha() for c in r["text"]))
    elif name == "line_dedup":
        assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r["doc_id"]) for r in given)
        by = {r["doc_id"]: r["text"] for r in found if r["doc_id"] is not None}
        # of equal texts the least id keeps its lines; rows that repeat an id stay alike; the case of letters does not tell lines apart
        assert by[4] == next(r["text"] for r in given if r["doc_id"] == 4) and by[5] == "" and by[9] == "w" * 400_000 + " end"
        assert sorted(r["text"] or "" for r in found if r["doc_id"] is None) == ["", "Short line\nother thing"]
        assert all(r["n_chars"] == (len(r["text"]) if r["text"] is not None else None) for r in found if r["text"])
    elif name == "near_dedup":
        # 4 is twice there, 5 and 6 are its copies, 9 is that of 8
        assert sorted(r["doc_id"] for r in found if r["doc_id"] is not None) == [1, 2, 3, 4, 4, 8, *range(20, 32)]
        assert sum(r["doc_id"] is None for r in found) == 2
    elif name == "mixing":
        plan = mixing.mix(odd.select("doc_id", "text", "source"), ("text",)).collect()
        assert len(found) == sum(-(-r["taken"] // r["size"]) for r in plan if r["taken"])
        assert all(any(c > " " for c in r["text"]) for r in found)
    else:
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(bpe.vocabulary_path())
        want = {str(r["doc_id"]) + (r["text"] or "")[:20]: lib.encode(r["text"] or "", add_special_tokens=False).ids for r in given}
        assert len(found) == len(given) and sorted(map(tuple, (r["ids"] for r in found))) == sorted(map(tuple, [want[str(r["doc_id"]) + (r["text"] or "")[:20]] for r in given]))


def test_pipeline_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "line_dedup", "near_dedup", "mixing", "bpe"]


def test_shares_follow_schedules(spark):
    """The first source asks for the same at any time, the second for ever more: the first one's share falls."""
    rows = [(i, "w " * 20, s) for i, s in enumerate(["a"] * 300 + ["b"] * 300)]
    got = [r["source"] for r in corpus_pipeline.mixed(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "").collect()]
    tenth = len(got) / 10
    share = [got[int(k * tenth) : int((k + 1) * tenth)].count("a") / tenth for k in range(10)]
    assert all(x > y - 0.02 for x, y in zip(share, share[1:], strict=False)) and share[0] > share[-1] + 0.2


def test_operators_on_clashing_names_and_long_texts(odd, empty):
    prints = fingerprints.fingerprints(odd)
    assert prints.columns == [*odd.columns, "fingerprint", "canonical_length"] and prints.count() == odd.count()
    assert fingerprints.fingerprint_report(odd).count() == odd.count()
    kept = line_dedup.deduplicate(odd)
    assert kept.columns == [*[c for c in odd.columns if c != "n_lines"], "n_lines", "n_removed"]
    near = near_dedup.near_duplicates(odd).collect()
    assert len(near) == odd.count() and all(r["kept"] for r in near if r["doc_id"] is None)
    cut = suffix_dedup.deduplicate(odd).collect()
    assert sum(r["n_bytes"] for r in cut) == sum(len((r["text"] or "").encode()) for r in odd.collect())
    assert toxicity.score(odd, (np.zeros(0, np.uint64), np.zeros(0), -1.0)).count() == odd.count()
    for made in (fingerprints.fingerprints(empty), line_dedup.deduplicate(empty), mixing.copies(empty)):
        assert made.count() == 0


def test_near_dedup_of_one_template(spark):
    """600 texts of 24 words from one template in 300 pairs, each pair alike and no other."""
    rng = random.Random(3)
    template = [f"t{i}" for i in range(18)]
    texts = []
    for i in range(300):
        words = template + [f"p{i}x{k}" for k in range(6)]
        texts += [" ".join(words), " ".join([*words[:-1], f"q{i}"])]
    order = rng.sample(range(600), 600)
    frame = spark.createDataFrame([(order[i], t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    sets = [{tuple(w[i : i + 5]) for i in range(20)} for w in (t.split() for t in texts)]
    links = [(i, j) for i in range(600) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    group = list(range(600))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, j in links:
        a, b = sorted((find(i), find(j)))
        group[b] = a
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame).collect()}
    members = {}
    for i in range(600):
        members.setdefault(find(i), []).append(order[i])
    assert got == {d: min(m) for m in members.values() for d in m} and len(members) == 300


def test_line_dedup_of_one_template(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8)))
    template, lines_ = [word() for _ in range(16)], []
    for _ in range(600):
        words = list(template)
        words[rng.randrange(16)] = word()
        lines_.append(" ".join(words))
    sets, group = [{x[i : i + 5] for i in range(len(x) - 4)} for x in lines_], list(range(600))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(600):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                group[b] = a
    frame = spark.createDataFrame(list(enumerate(lines_)), "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.deduplicate(frame).collect()}
    assert got == {i: int(find(i) != i) for i in range(600)} and 300 < sum(got.values()) < 600


def test_archive_is_parsed_record_by_record(spark):
    pages = spark.createDataFrame([(1, "http://a/1", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (3, None, None), (4, "u", ""), (5, "u", "a\r\n\r\nWARC/1.1\r\n\r\n"), (None, "u", "x" * 3_000_000)], "page_id long, url string, html string")
    path = fresh_path(spark, "test")
    warc.write_archive(pages, path)
    got = {r["page_id"]: r for r in warc.parsed(warc.record_bytes(warc.read_archive(spark, path))).collect()}
    for r in pages.collect():
        payload = (r["html"] or "").encode()
        assert (got[r["page_id"]]["payload_bytes"], got[r["page_id"]]["payload_digest"]) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), None: ("response", None)}
    warc.write_archive(pages.limit(0), f"{path}-none")
    assert warc.parsed(warc.record_bytes(warc.read_archive(spark, f"{path}-none"))).count() == 0
    with pytest.raises(ValueError, match="does not end"):
        warc._taken_apart(memoryview(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nab\r\n\r\n"))


def test_language_model_is_counted(spark):
    """Against counts by dictionary."""
    rng = random.Random(5)
    rows = [(i, prose(rng, 30) if i % 2 else " ".join(rng.choice(["und", "der", "öl", "ẞ", "x1"]) for _ in range(30)), ["de", "fr"][i % 2]) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, matrix = langid.train(frame)
    counts = {k: {} for k in langs}

    def features(text):
        points = [ord(c) if c.isalpha() else 32 for c in text.lower()]
        for n in langid.LENGTHS:
            for i in range(len(points) - n + 1):
                h = n * 0x9E3779B1
                for p in points[i : i + n]:
                    h = (h * 0x100000001B3 + p) % 2**64
                yield int(langid.mix64(np.array([h], np.uint64))[0]) % langid.FEATURES

    for _, text, lang in rows:
        for f in features(text):
            counts[lang][f] = counts[lang].get(f, 0) + 1
    for k, lang in enumerate(langs):
        total = sum(counts[lang].values()) + 0.5 * langid.FEATURES
        want = np.log(np.array([counts[lang].get(f, 0) + 0.5 for f in range(langid.FEATURES)]) / total)
        assert np.allclose(matrix[:-1, k], want, atol=1e-5) and np.isclose(matrix[-1, k], np.log(0.5), atol=1e-6)
    got = {r["doc_id"]: r for r in langid.classify(frame, (langs, matrix)).collect()}
    for i, text, _ in rows[:10]:
        sums = np.array([sum(float(matrix[f, k]) for f in features(text)) + float(matrix[-1, k]) for k in range(2)])
        assert got[i]["lang_pred"] == langs[int(sums.argmax())] and abs(got[i]["score"] - 1 / np.exp(sums - sums.max()).sum()) < 1e-3


def test_no_language_is_left_out(spark):
    rows = [(k, chr(0x4E00 + k) * 8, f"l{k:03}") for k in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, matrix = langid.train(frame)
    assert len(langs) == 600 and matrix[:-1].size <= langid.CELLS
    assert np.mean([r["lang"] == r["lang_pred"] for r in langid.classify(frame, (langs, matrix)).collect()]) > 0.95


def test_toxicity_reaches_the_least_risk():
    """The risk that Adam reaches against that of many plain steps down the gradient."""
    rng = np.random.default_rng(4)
    keys, prior = np.arange(6, dtype=np.uint64), 0.2
    positive = [np.flatnonzero(rng.random(6) < [0.9, 0.5, 0.1, 0.3, 0.3, 0.3]).astype(np.uint16) for _ in range(80)]
    unlabelled = [np.flatnonzero(rng.random(6) < [0.2, 0.3, 0.2, 0.3, 0.3, 0.3]).astype(np.uint16) for _ in range(300)]
    x = np.array([[k in t for k in range(6)] for t in [*positive, *unlabelled]], float)

    def risk(w, b):
        f = x @ w + b
        p, u = f[:80], f[80:]
        rest = np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()
        return prior * np.logaddexp(0, -p).mean() + max(0.0, rest) + 5e-5 * (w @ w), rest

    _, w, b = toxicity.fit(keys, positive, unlabelled, prior)
    v, c = np.zeros(6), float(np.log(prior / (1 - prior)))
    for _ in range(4000):
        s = 1 / (1 + np.exp(-(x @ v + c)))
        g = np.concatenate([prior * (s[:80] - 1) / 80 - prior * s[:80] / 80, s[80:] / 300])
        g = g if risk(v, c)[1] >= 0 else np.concatenate([prior * s[:80] / 80, -s[80:] / 300])
        v, c = v - 0.5 * (x.T @ g + 1e-4 * v), c - 0.5 * g.sum()
    assert risk(w, b)[0] <= risk(v, c)[0] + 2e-3 and risk(w, b)[0] < risk(np.zeros(6), 0.0)[0]


def test_toxicity_words_are_those_of_the_test(spark):
    rng = random.Random(2)
    texts = [([i for i in range(40) if rng.random() < (0.8 if t and i < 5 else 0.3)], t) for t in [1] * 60 + [0] * 140]
    got = toxicity.select(spark.createDataFrame(texts, "words array<long>, toxic int"))
    want = []
    for w in range(40):
        seen, against = (sum(w in x for x, t in texts if t == k) for k in (1, 0))
        share = (seen + against) / 200
        if seen >= toxicity.MIN_TEXTS and (seen / 60 - against / 140) / (share * (1 - share) * (1 / 60 + 1 / 140)) ** 0.5 >= toxicity.MIN_Z:
            want.append(w)
    assert got.tolist() == want and want


def test_top_k_of_large_numbers_and_many_blocks(spark):
    rng = np.random.default_rng(6)
    values = rng.integers(-1000, 1000, (200, 8))
    values[40] = 6 * 10**13
    frame = spark.createDataFrame([(i, [int(x) for x in v]) for i, v in enumerate(values)] + [(40, [int(x) for x in values[40]]), (None, None)], "vec_id long, v array<long>").where("vec_id is not null")
    got = topk.top_k(frame, frame.where("vec_id % 20 = 0"), 7, block=3).collect()
    exact = values.astype(object) @ values.astype(object).T
    for i in range(0, 200, 20):
        others = [(-exact[i][j], j) for j in [*range(200), 40] if j != i]
        assert [(r["score"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == i] == [(-s, j) for s, j in sorted(others)[:7]]
    big = spark.createDataFrame([(0, [2**40] * 8), (1, [2**40] * 8)], "vec_id long, v array<long>")
    with pytest.raises(Exception, match="does not fit a long"):
        topk.top_k(big, big.where("vec_id = 0"), 1).collect()
    made = spark.createDataFrame([(0, [1e13, 1.0]), (1, [float("inf"), 1.0]), (2, [0.5, None])], "vec_id long, e array<double>")
    assert [r["v"] for r in made.orderBy("vec_id").select(topk.quantised(topk.F.col("e")).alias("v")).collect()] == [[640000000000000, 64], None, None]


def test_bounds_leave_out_pairs():
    """Where vectors lie in clusters, most pairs are dropped before they are scored, and none of the best."""
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 4000, (40, 32))
    x = np.floor(centres[np.arange(4000) % 40] + rng.normal(0, 60, (4000, 32)))
    ids = np.arange(4000)
    search = topk.Search(ids[:80], x[:80], 5)
    for at in range(0, 4000, 500):
        search.feed(ids[at : at + 500], x[at : at + 500])
    assert search.scored < 0.35 * search.pairs
    scores = (x[:80] @ x.T).astype(np.int64)
    scores[np.arange(80), np.arange(80)] = np.iinfo(np.int64).min
    assert (np.sort(scores, 1)[:, -5:][:, ::-1] == search.scores).all()
