"""Document fingerprints: canonical exact digests, native operations only.

A text is brought to a canonical form (Unicode composition, case folding, white space folding), hashed to 128 bits by
two xxhash64 passes, and grouped by the hash. Only inside groups that hold more than one row are bytes compared; if
such a group really holds different canonical texts, their order by bytes is appended to the fingerprint, so equal
fingerprints always mean equal canonical texts.

Defined cases: a null text is the empty text; extra columns are ignored; rows that repeat a doc_id are ordered by text;
a null doc_id sorts as the smallest; the table may be empty (no rows come out).
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import having, partitions, stored, table

_NO_ID = -(1 << 63)


def _class(points: list[int]) -> str:
    """A Java character class of these sorted code points."""
    spans: list[list[int]] = []
    for p in points:
        if spans and spans[-1][1] == p - 1:
            spans[-1][1] = p
        else:
            spans.append([p, p])
    return "".join(f"\\x{{{a:x}}}" + (f"-\\x{{{b:x}}}" if b > a else "") for a, b in spans)


@cache
def _unicode_rules() -> dict:
    """From the Unicode database: what composition may touch, decompositions, classes of marks, primary composites."""
    touched, seconds, parts, order, pairs = [], {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}, {}, {}, {}
    for p in [*range(0xD800), *range(0xE000, 0x110000)]:
        c = chr(p)
        if k := unicodedata.combining(c):
            order[c] = str(k)
        if 0xAC00 <= p < 0xD7A4 or (d := unicodedata.normalize("NFD", c)) == c:
            continue
        parts[c] = d
        if unicodedata.normalize("NFC", c) != c:
            touched.append(p)
        elif len(d) > 1:
            pairs[unicodedata.normalize("NFC", d[:-1]) + d[-1]] = c
            seconds.add(ord(d[-1]))
    joins = {*seconds, *map(ord, order)}
    return {"joins": _class(sorted(joins)), "alone": _class(sorted({*touched} - joins)), "marks": _class(sorted(map(ord, order))), "parts": parts, "order": order, "pairs": pairs}


def _map(entries: dict) -> Column:
    return F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in entries.items())), F.lit("\x01"), F.lit("\x02"))


def composed(text: Column) -> Column:
    """Canonical composition (NFC). Texts without a code point that it may touch pass as they are.

    Others are cut so that each character stays with the marks and joining letters after it; a piece that composition
    may touch is decomposed, its marks are ordered by class, and it is composed again. All else is left alone.
    """
    rules = _unicode_rules()
    parts, order, pairs = (_map(rules[k]) for k in ("parts", "order", "pairs"))
    joins, alone, marks = rules["joins"], rules["alone"], rules["marks"]
    #: nothing below U+0300 is touched, so that one cheap test spares most characters the long classes
    touched = rf"(?=[\x{{300}}-\x{{10ffff}}])[{joins}{alone}]"

    def code(c: Column) -> Column:
        return F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("int")

    def char(n: Column) -> Column:
        return F.decode(F.unhex(F.lpad(F.hex(n), 4, "0")), "UTF-16BE")

    def put(s: Column, x: Column) -> Column:
        """s: text done, the last starter, marks after it that did not compose, the class of the last of those."""
        k, c = x["k"], x["c"]
        lead, tail = code(s["last"]), code(c)
        jamo = (s["last"] >= "ᄀ") & (c >= "ᅡ") & (c <= "ᇂ")
        hangul = F.when(jamo & lead.between(0x1100, 0x1112) & tail.between(0x1161, 0x1175), char(((lead - 0x1100) * 21 + tail - 0x1161) * 28 + 0xAC00)).when(
            jamo & lead.between(0xAC00, 0xD7A3) & ((lead - 0xAC00) % 28 == 0) & tail.between(0x11A8, 0x11C2), char(lead + tail - 0x11A7)
        )
        joined = F.coalesce(F.try_element_at(pairs, F.concat(s["last"], c)), hangul)
        joined = F.when((F.length(s["last"]) > 0) & ((s["rest"] == "") | (s["k"] < k)), joined)
        return F.struct(
            F.when(joined.isNotNull() | (k > 0), s["done"]).otherwise(F.concat(s["done"], s["last"], s["rest"])).alias("done"),
            F.when(joined.isNotNull(), joined).when(k > 0, s["last"]).otherwise(c).alias("last"),
            F.when(joined.isNotNull(), s["rest"]).when(k > 0, F.concat(s["rest"], c)).otherwise(F.lit("")).alias("rest"),
            F.when(joined.isNotNull(), s["k"]).otherwise(k).alias("k"),
        )

    def piece(p: Column) -> Column:
        apart = F.array_join(F.transform(F.split(p, ""), lambda c: F.coalesce(F.try_element_at(parts, c), c)), "")
        runs = F.regexp_extract_all(apart, F.lit(f"(?s)[^{marks}][{marks}]*|[{marks}]+"), F.lit(0))
        sort = lambda r: F.array_sort(F.transform(F.split(r, ""), lambda c, i: F.struct(F.coalesce(F.try_element_at(order, c), F.lit("0")).cast("int").alias("k"), i.alias("i"), c.alias("c"))))
        start = F.struct(F.lit("").alias("done"), F.lit("").alias("last"), F.lit("").alias("rest"), F.lit(0).alias("k"))
        return F.aggregate(F.flatten(F.transform(runs, sort)), start, put, lambda s: F.concat(s["done"], s["last"], s["rest"]))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s)[^{joins}]?[{joins}]+|[{alone}]|[^{joins}{alone}]+(?![{joins}])|."), F.lit(0))
    slow = F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(touched), piece(p)).otherwise(p)), "")
    return F.when(text.rlike(touched), slow).otherwise(text)


#: White space as Unicode has it (fixed values).
SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def canonical(text: Column) -> Column:
    """Canonical composition, case folding (upper, then lower, final sigma as sigma), each run of white space as one space, none at the ends. Null is empty."""
    folded = F.translate(F.lower(F.upper(composed(F.coalesce(text, F.lit(""))))), "ς", "σ")
    return F.trim(F.regexp_replace(folded, SPACE, " "))


def wide_hash(text: Column, a: str, b: str) -> list[Column]:
    return [F.xxhash64(text).alias(a), F.xxhash64(F.lit("wide"), text).alias(b)]


def digest(a: str, b: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


def collision_ranks(rows: DataFrame) -> DataFrame | None:
    """rows (a, b, canon): where unequal canonical texts share a hash, (a, b, proof, place) ranks them by bytes. None if there are none.

    Equal texts meet in the map-side half of the aggregation, so that a group of copies of any size costs a row a task.
    """
    distinct = rows.groupBy("a", "b", "canon").agg(F.count("*").alias("n")).groupBy("a", "b").agg(F.count("*").alias("texts"), F.min("canon").alias("least"), F.max("canon").alias("most"))
    shared = stored(distinct.where("texts > 1 and least <> most").select("a", "b"), "shared-hashes")
    if shared.isEmpty():
        return None
    inside = rows.join(shared, ["a", "b"], "left_semi").select("a", "b", "canon").distinct()
    place = F.row_number().over(Window.partitionBy("a", "b").orderBy("canon"))
    return inside.select("a", "b", F.sha2("canon", 256).alias("proof"), place.alias("place"))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column fingerprint (and canonical_length); equal fingerprints mean equal canonical texts.

    Only hashes are shuffled to find groups of more than one row; texts follow only for those.
    """
    docs = docs.drop("fingerprint", "canonical_length")
    # rows are carried as one struct, so that no name of theirs can clash
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), canonical(F.col(text)).alias("canon"))
    rows = rows.select("row", "canon", *wide_hash(F.col("canon"), "a", "b"))
    groups = stored(rows.groupBy("a", "b").count().where("count > 1").select("a", "b"), "groups")
    ranks = collision_ranks(having(rows.select("a", "b", "canon"), groups, ["a", "b"]))
    out = rows.select("row", "a", "b", F.char_length("canon").alias("canonical_length"), F.sha2("canon", 256).alias("proof"))
    mark = F.lit("")
    if ranks is not None:
        out = out.join(ranks, ["a", "b", "proof"], "left")
        mark = F.coalesce(F.concat(F.lit("-"), F.col("place").cast("string")), F.lit(""))
    return out.select("row.*", F.concat(digest("a", "b"), mark).alias("fingerprint"), "canonical_length")


def with_next(docs: DataFrame) -> DataFrame:
    """Each row's text beside that of the next row by descending (doc_id, text); the last row's next is the first.

    Ids are cut into ranges at ids that occur. A range is one window partition; a row at a cut also goes, as a guest,
    to the range above, whose last row needs it. So texts are shuffled once and no task holds more than a range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).cast("long").alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = 8 * partitions(spark)
    cuts = rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 20 * n).alias("c"), F.max("key").alias("top")).first()
    if cuts["top"] is None:
        return rows.select("doc_id", "text", "key", F.col("text").alias("next_text"), F.col("key").alias("next_key"))
    cuts = sorted({*cuts["c"], cuts["top"]})
    wide = max(1, round(len(cuts) ** 0.5))
    all_cuts, coarse = F.array(*map(F.lit, cuts)), F.array(*map(F.lit, cuts[wide - 1 :: wide]))
    #: ranges below the row: whole strides first, then one by one inside a stride
    block = F.size(F.filter(coarse, lambda x: x < F.col("key")))
    rows = rows.withColumn("block", block).withColumn("range", F.col("block") * wide + F.size(F.filter(F.slice(all_cuts, F.col("block") * wide + 1, wide), lambda x: x < F.col("key"))))
    at_cut = F.element_at(all_cuts, F.col("range") + 1) == F.col("key")
    to = F.when(at_cut, F.array(F.struct(F.col("range").alias("r"), F.lit(0).alias("guest")), F.struct(((F.col("range") + 1) % len(cuts)).alias("r"), F.lit(1).alias("guest")))).otherwise(F.array(F.struct(F.col("range").alias("r"), F.lit(0).alias("guest"))))
    dealt = rows.select("doc_id", "key", "text", F.explode(to).alias("to")).select("doc_id", "key", "text", "to.r", "to.guest")
    order = Window.partitionBy("r").orderBy("guest", F.col("key").desc(), F.col("text").desc())
    nexts = {"next_text": F.lead("text").over(order), "next_key": F.lead("key").over(order)}
    return dealt.withColumns(nexts).where("guest = 0").select("doc_id", "text", "key", "next_text", "next_key")


def _edited() -> Column:
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs.

    The edited text has its last half replaced by the start of the next text. Likeness is that of exact digests: 1 for
    equal canonical texts, else 0. A table of one row is its own next.
    """
    pairs = with_next(docs).withColumn("edited", _edited())
    forms = F.transform(F.array("text", "edited", "next_text"), canonical)
    canon = pairs.select("doc_id", "key", "next_key", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), forms.alias("forms"))
    canon = canon.select("*", F.col("forms")[0].alias("c"), F.col("forms")[1].alias("e"), F.col("forms")[2].alias("x"))
    near = lambda other: (F.col("c") == F.col(other)).cast("double")
    rows = stored(canon.select("doc_id", "key", "next_key", "n_chars", "edited_sha256", *wide_hash(F.col("c"), "a", "b"), *wide_hash(F.col("e"), "ea", "eb"), F.sha2("c", 256).alias("proof"), F.sha2("e", 256).alias("edited_proof"), near("e").alias("near_edited"), near("x").alias("near_next")), "fingerprints")
    hashes = rows.select("a", "b", F.lit(0).alias("edit")).unionByName(rows.select(F.col("ea").alias("a"), F.col("eb").alias("b"), F.lit(1).alias("edit")))
    groups = stored(hashes.groupBy("a", "b").agg(F.count("*").alias("n"), F.sum("edit").alias("edits")).where("n > 1"), "groups")
    own = docs.select(canonical(F.col("text")).alias("canon")).select(*wide_hash(F.col("canon"), "a", "b"), "canon")
    inside = having(own, groups.select("a", "b"), ["a", "b"])
    mixed = groups.where("edits > 0").select("a", "b")
    if not mixed.isEmpty():
        # only the rows in question and their nexts are put side by side again: no other row stands between those
        wanted = rows.join(mixed.select(F.col("a").alias("ea"), F.col("b").alias("eb")), ["ea", "eb"], "left_semi").select(F.explode(F.array("key", "next_key")).alias("key"))
        some = having(docs.withColumn("key", F.coalesce("doc_id", F.lit(_NO_ID)).cast("long")), stored(wanted.distinct(), "wanted"), ["key"])
        edited = with_next(some).select(canonical(_edited()).alias("canon")).select(*wide_hash(F.col("canon"), "a", "b"), "canon")
        inside = inside.unionByName(having(edited, mixed, ["a", "b"]))
    ranks = collision_ranks(inside)
    marks = [F.lit(""), F.lit("")]
    if ranks is not None:
        for i, (a, b, proof) in enumerate((("a", "b", "proof"), ("ea", "eb", "edited_proof"))):
            rows = rows.join(ranks.select(F.col("a").alias(a), F.col("b").alias(b), F.col("proof").alias(proof), F.col("place").alias(f"place{i}")), [a, b, proof], "left")
            marks[i] = F.coalesce(F.concat(F.lit("-"), F.col(f"place{i}").cast("string")), F.lit(""))
    return rows.select("doc_id", "n_chars", "edited_sha256", F.concat(digest("a", "b"), marks[0]).alias("fingerprint"), F.concat(digest("ea", "eb"), marks[1]).alias("edited_fingerprint"), "near_edited", "near_next")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_report(table(spark, sf_dir, "documents"))
