"""SpotSigs document fingerprints with DataFrame functions only (operator 3).

Words are runs of letters and digits, lower-cased.  A content word that directly
follows a common word (an anchor) begins a chain: the anchor and CHAIN content words
from there on, other common words left out.  The hashes of a document's chains are its
signature set; a text without a chain has one signature, of all its words, or of the
text if it has no word.  The fingerprint is the set's size and a digest of the set,
so equal sets, and with them equal texts, have equal fingerprints.  Likeness is the
Jaccard similarity of two sets.

`matches` finds the similar documents of a table: sets are partitioned by length into
bands, so that only neighbouring bands can hold a pair, and only the rarest
signatures of each set, as many as a pair of that likeness cannot do without, are
joined; the pairs left are compared on whole sets.

Cases: null counts as empty; an empty text has no signature.  Two empty sets are alike
(1.0), an empty and another one are not (0.0).  Rows with one doc_id are ordered
by their text.  A null doc_id comes after all others.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import texts

CHAIN = 3
# Common words of English, French, German and Spanish (fixed values).
ANCHORS = """a an and are as at be by for from he in is it of on or that the this to was were will with
au aux avec ce dans de des du elle en est et il la le les ou par pas pour que qui sur un une
auf aus das dem den der des die ein eine er es im ist mit nicht sich sie und von zu
al como con del el ella es esta la las lo los no o para por se su una y""".split()
#: Rows of one stretch of neighbouring ids, and stretches at most.
STRETCH, STRETCHES = 20_000, 10_000


def let(value: Column, f) -> Column:
    """f(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """Sorted array<long> of a text's distinct signatures."""
    def chains(words: Column) -> Column:
        placed = F.transform(words, lambda w, i: F.struct(w.alias("w"), F.when(i > 0, F.get(words, i - 1)).alias("before")))
        content = F.filter(placed, lambda s: ~s["w"].isin(ANCHORS))

        def of(c: Column) -> Column:
            return F.filter(F.transform(c, lambda s, k: F.when(
                s["before"].isin(ANCHORS) & (k + chain <= F.size(c)),
                F.xxhash64(s["before"], s["w"], *(F.get(c, k + j)["w"] for j in range(1, chain))))), lambda h: h.isNotNull())

        found = let(content, of)
        whole = F.when(F.size(words) > 0, F.xxhash64(F.array_join(words, " "))).otherwise(F.xxhash64(text))
        return F.when(F.size(found) > 0, found).when(text == "", F.array().cast("array<long>")).otherwise(F.array(whole))

    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.sort_array(F.array_distinct(let(words, chains)))


def fingerprint(sigs: Column) -> Column:
    """The set's size and a digest of the sorted set."""
    return F.concat_ws(":", F.size(sigs).cast("string"), F.sha2(F.array_join(sigs.cast("array<string>"), ","), 256))


def likeness(a: Column, b: Column, at_least: float = 0.0) -> Column:
    """Jaccard similarity of two sets; pairs whose sizes alone rule out `at_least`
    are 0 without a look at the sets."""
    low, high = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    exact = let(F.size(F.array_intersect(a, b)), lambda both: both / (F.size(a) + F.size(b) - both))
    return F.when(high == 0, 1.0).when((low == 0) | (low < at_least * high), 0.0).when(a == b, 1.0).otherwise(exact)


def _stretch(ids: DataFrame) -> tuple[int, list[int]]:
    """Bounds that cut the ids into stretches of about STRETCH rows."""
    n = ids.count()
    k = max(1, min(STRETCHES, -(-n // STRETCH)))
    if k == 1:
        return n, []
    bounds = ids.agg(F.percentile_approx("o", [i / k for i in range(1, k)], 10 * STRETCHES)).first()[0]
    return n, sorted(set(bounds))


def with_next(docs: DataFrame) -> DataFrame:
    """Each row (o, text, sigs) with the next one's text and sigs in descending order of
    o, the last one with the first one's.  Every stretch of ids is sorted by itself; the
    first row of the stretch below is copied into it."""
    _, bounds = _stretch(docs.select("o"))
    k = len(bounds)
    steps = [1 << b for b in reversed(range(k.bit_length()))]
    if k:
        known = F.array(*(F.lit(b) for b in bounds))
        at = F.aggregate(F.array(*(F.lit(s) for s in steps)), F.lit(0), lambda p, s: F.when(
            (p + s <= k) & (F.get(known, p + s - 1) < F.col("o")), p + s).otherwise(p))
    else:
        at = F.lit(0)
    rows = docs.withColumn("stretch", at).withColumn("copy", F.lit(False))
    tops = rows.groupBy("stretch").agg(F.max("o").alias("top"))  # STRETCHES rows at most
    below = F.lead("top").over(Window.orderBy(F.desc("stretch")))
    first = F.max("top").over(Window.partitionBy())
    wanted = tops.select(F.col("stretch").alias("into"), F.coalesce(below, first).alias("top"))
    copies = rows.join(F.broadcast(wanted), rows["o"] == wanted["top"]).select(
        *(F.col("into").alias("stretch") if c == "stretch" else F.lit(True).alias("copy") if c == "copy" else F.col(c) for c in rows.columns))
    order = Window.partitionBy("stretch").orderBy("copy", F.desc("o"), F.desc("text"))
    return (rows.unionByName(copies)
            .withColumn("next", F.lead(F.struct("text", "sigs")).over(order))
            .filter(~F.col("copy")).drop("copy", "stretch"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next of every row; the edited text has its second half replaced by the
    first half's length of the next document."""
    rows = texts(docs).select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("o"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows.withColumn("sigs", signatures(F.col("text"))))
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), "sigs", F.col("next.sigs").alias("next_sigs"),
                       F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring(F.col("next.text"), F.lit(1), half)).alias("edited"))
    rows = rows.withColumn("edited_sigs", signatures(F.col("edited")))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                       fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
                       likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
                       likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"))


def matches(docs: DataFrame, at_least: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): fingerprint and class of every row (doc_id, class), the class
    being the least doc_id of that fingerprint; and the pairs (a, b, likeness) of
    different classes with a likeness of `at_least` or more, a < b."""
    sets = texts(docs).filter("doc_id is not null").select("doc_id", signatures(F.coalesce("text", F.lit(""))).alias("sigs"))
    sets = sets.withColumn("fingerprint", fingerprint(F.col("sigs")))
    classes = sets.filter(F.size("sigs") > 0).groupBy("fingerprint").agg(F.min("doc_id").alias("class"), F.first("sigs").alias("sigs"))
    members = sets.groupBy("doc_id", "fingerprint").agg(F.count("*").alias("n")).join(classes.select("fingerprint", "class"), "fingerprint", "left").select("doc_id", "fingerprint", "class")
    each = classes.select("class", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    common = each.groupBy("sig").agg(F.count("*").alias("df"))
    ranked = each.join(common, "sig").groupBy("class", "n").agg(F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("s"))
    prefix = ranked.select("class", "n", F.explode(F.slice("s", F.lit(1), (F.col("n") - F.ceil(F.col("n") * at_least) + 1).cast("int"))).alias("s")).select(
        "class", "n", "s.sig", F.floor(F.log(F.col("n")) / -F.log(F.lit(at_least))).alias("band"))
    left = prefix.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1)))  # the band of the longer set
    right = prefix.select(F.col("class").alias("other"), F.col("n").alias("m"), "sig", "band")
    pairs = (left.join(right, ["sig", "band"])
             .filter((F.col("class") != F.col("other")) & (F.col("n") <= F.col("m")) & (F.col("n") >= at_least * F.col("m")))
             .select(F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b")).distinct())
    full = classes.select("class", "sigs")
    pairs = (pairs.join(full.toDF("a", "x"), "a").join(full.toDF("b", "y"), "b")
             .select("a", "b", likeness(F.col("x"), F.col("y"), at_least).alias("likeness")).filter(F.col("likeness") >= at_least))
    return members, pairs
