"""Near-duplicate records with small edits: an exact set-similarity join on deletion-variant signatures.

A record is the bit vector of its distinct words. Two records of Jaccard similarity t or more differ in at
most H = (|x| + |y|)(1 - t) / (1 + t) bits. The bits are cut by a hash of the word into m = H // 2 + 1
segments, too few for each to differ in two: one segment differs in at most one bit. Every segment is
indexed as it is and with each one of its set bits wiped out, so two such segments meet by equality (as they
are, or one as it is and the other with a bit wiped out), and pairs that met are verified on the words.

A signature carries its record's size and a sketch of its words, 112 bits of which every word sets one: sets
that differ in d words have sketches that differ in d bits at most, so what meets by chance is mostly told
before any words are fetched.

Segments made of the words of a common template would meet everywhere. Records under such a signature meet
again, instead, by their rarest words: of any p = |x| - o + r rarest words of x (o being the least overlap
that t demands) at least r stand in every partner, so the r-subsets of the p rarest words are signatures
too. A subset that is still crowded is extended by one more rare word, until none is or the subset is as
large as the overlap that makes two records similar. Both ways are complete; none drops a pair.

Records with equal word sets are one class throughout; they are expanded only at the end, if asked for.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.components import components
from corpusloom.runtime import stage

#: Classes that may share a signature and still be paired at once; beyond it the signature is refined.
CROWD = 48
#: A word in at least one of this many classes is frequent; there are at most this many times the mean
#: number of words of those, whatever the size of the table.
FREQUENT_ONE_IN = 2000
#: Words of the smallest subsets.
FEWEST_RARE = 2
#: Bits of the first and of the second word of a sketch; above the first ones stands the size, as this at most.
SKETCH, MORE, _MOST_SIZE = 48, 64, (1 << 15) - 1
#: Records whose signatures leave Python in one batch.
_BATCH = 256
_MASK = (1 << 64) - 1
_PLACE, _PLACES = struct.Struct("<I"), struct.Struct(f"<{FEWEST_RARE}I")


def words_of(text: Column) -> Column:
    """The distinct maximal runs of Unicode letters and digits of the lower-cased text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)))


def word_classes(records: DataFrame, kind: str, key: str, text: str, newest: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(classes, members): (kind, cls, words) per distinct word set, and (kind, cls, id) per record.

    Null ids and texts do not count; of rows repeated under one id the one with the latest ``newest`` (then
    the greatest text) does. Texts without words form no class: their similarity is undefined.
    """
    order = F.col(newest) if newest else F.lit(0)
    rows = records.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("string").alias("id"), F.col(text).alias("t"), order.alias("at"))
    rows = rows.groupBy("id").agg(F.max_by("t", F.struct("at", "t")).alias("t"))
    sets = rows.select("id", words_of(F.col("t")).alias("words")).where(F.size("words") > 0)
    members = sets.select(F.lit(kind).alias("kind"), F.xxhash64(F.lit(kind), F.array_join("words", " ")).alias("cls"), "id", "words")
    return members.groupBy("kind", "cls").agg(F.first("words").alias("words")), members.drop("words")


def size_class(n: int, t: float) -> int:
    """Sizes of one class differ by less than the factor 1 / t, so partners are in the same or the next class."""
    return int(math.floor(math.log(n) / math.log(1 / t) + 1e-9))


def _largest(c: int, t: float) -> int:
    n = max(1, int(math.floor((1 / t) ** (c + 1))) + 1)
    while size_class(n, t) > c:
        n -= 1
    return n


def _smallest(c: int, t: float) -> int:
    n = max(1, int(math.floor((1 / t) ** c)) - 1)
    while size_class(n, t) < c:
        n += 1
    return n


def _hash(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _groups(n: int, t: float) -> list[tuple[int, int]]:
    """The pairs of size classes in which a set of n words can have partners."""
    c = size_class(n, t)
    return [(c, c), (c, c + 1)] + ([(c - 1, c)] if c else [])


def _segment_count(low: int, high: int, t: float) -> int:
    differ = int(math.floor((_largest(low, t) + _largest(high, t)) * (1 - t) / (1 + t) + 1e-9))
    return differ // 2 + 1


def deletion_variants(words: list[str], kind: str, t: float) -> list[tuple[int, bool]]:
    """(signature, whole) of every segment, and of every segment with one word wiped out.

    A segment's value is the sum of its words' hashes, so wiping one out is a subtraction.
    """
    hashes = [_hash(w) for w in words]
    out = []
    for low, high in _groups(len(words), t):
        m = _segment_count(low, high, t)
        segments: list[list[int]] = [[] for _ in range(m)]
        for h in hashes:
            segments[(h >> 17) % m].append(h)
        for s, members in enumerate(segments):
            salt = _hash(f"{kind}/{low}/{high}/{s}")
            total = (salt + sum(members)) & _MASK
            out.append((_signed(total), True))
            out += [(_signed((total - h) & _MASK), False) for h in members]
    return out


def _rarest_first(words: list[str], rank: dict[str, int]) -> list[int]:
    """Hashes of the words; frequent ones last, by falling rarity, the others in the order of their hashes."""
    return [h for _, h in sorted((rank.get(w, -1), _hash(w)) for w in words)]


def _least_overlap(n: int, t: float) -> int:
    """Words that a set of n words shares at least with any partner."""
    return int(math.ceil((n + math.ceil(t * n - 1e-9)) * t / (1 + t) - 1e-9))


def rare_subsets(words: list[str], rank: dict[str, int], kind: str, t: float) -> list[tuple[int, bytes]]:
    """(signature, places) of the smallest subsets of the rarest words; none for sets without any partner."""
    n = len(words)
    least = _least_overlap(n, t)
    if least < FEWEST_RARE:  # a single word has no partner but itself
        return []
    ordered, salt = _rarest_first(words, rank), _hash(kind)
    return [(_signed((salt + sum(ordered[i] for i in at)) & _MASK), _PLACES.pack(*at)) for at in combinations(range(min(n, n - least + FEWEST_RARE)), FEWEST_RARE)]


def extended_subsets(words: list[str], rank: dict[str, int], t: float, r: int, crowded: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    """The r-subsets that extend a crowded (r - 1)-subset by a less rare word.

    Two partners' r rarest common words extend their r - 1 rarest ones, so no other extension is needed.
    """
    n = len(words)
    least = _least_overlap(n, t)
    ordered = _rarest_first(words, rank)
    out = []
    for sig, places in crowded:
        last = _PLACE.unpack(places[-_PLACE.size :])[0]
        out += [(_signed((sig + ordered[j]) & _MASK), places + _PLACE.pack(j)) for j in range(last + 1, min(n, n - least + r))]
    return out


def sketch(words: list[str]) -> tuple[int, int]:
    """A set's size (up to a bound) above the first of the bits that its words set, and the other bits."""
    bits = 0
    for w in words:
        bits |= 1 << (_hash(w) >> 7) % (SKETCH + MORE)
    return min(len(words), _MOST_SIZE) << SKETCH | bits & ((1 << SKETCH) - 1), _signed(bits >> SKETCH)


def _may_be_similar(x: str, y: str, t: float) -> Column:
    """Whether sets with these sketches can have a Jaccard similarity of ``t``."""
    size = lambda c: F.shiftright(c, SKETCH)
    differ = F.bit_count(F.col(x).bitwiseXOR(F.col(y)).bitwiseAND((1 << SKETCH) - 1)) + F.bit_count(F.col(f"{x}2").bitwiseXOR(F.col(f"{y}2")))
    n = size(x) + size(y)
    return (size(x) == _MOST_SIZE) | (size(y) == _MOST_SIZE) | (differ <= n * ((1 - t) / (1 + t)) + 1e-6) & (F.least(size(x), size(y)) >= F.greatest(size(x), size(y)) * t - 1e-6)


def _map(df: DataFrame, inputs: list[str], schema: str, types: list, make) -> DataFrame:
    """Rows made by ``make(*values)`` of each row, leaving Python in batches of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [n for n, _ in types]
        for batch in batches:
            for at in range(0, batch.num_rows, _BATCH):
                part = batch.slice(at, _BATCH)
                rows = [row for values in zip(*(part.column(c).to_pylist() for c in inputs)) for row in make(*values)]
                columns = list(zip(*rows)) if rows else [[] for _ in types]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, types)], names=names)

    return df.mapInArrow(run, schema)


_SIG_ROW = [("sig", pa.int64()), ("places", pa.binary()), ("done", pa.bool_()), ("cls", pa.int64()), ("sk", pa.int64()), ("sk2", pa.int64())]
_SIG_SCHEMA = "sig long, places binary, done boolean, cls long, sk long, sk2 long"


def _variant_rows(classes: DataFrame, t: float) -> DataFrame:
    def make(kind, cls, words):
        sk = sketch(words)
        return [(sig, whole, cls, *sk) for sig, whole in deletion_variants(words, kind, t)]

    return _map(classes, ["kind", "cls", "words"], "sig long, whole boolean, cls long, sk long, sk2 long", [("sig", pa.int64()), ("whole", pa.bool_()), ("cls", pa.int64()), ("sk", pa.int64()), ("sk2", pa.int64())], make)


def _subset_rows(classes: DataFrame, rank: dict[str, int], t: float) -> DataFrame:
    def make(kind, cls, words):
        sk, done = sketch(words), _least_overlap(len(words), t) <= FEWEST_RARE
        return [(sig, places, done, cls, *sk) for sig, places in rare_subsets(words, rank, kind, t)]

    return _map(classes, ["kind", "cls", "words"], _SIG_SCHEMA, _SIG_ROW, make)


def _extended_rows(classes: DataFrame, rank: dict[str, int], t: float, r: int) -> DataFrame:
    def make(cls, words, crowded):
        sk, done = sketch(words), _least_overlap(len(words), t) <= r
        return [(sig, places, done, cls, *sk) for sig, places in extended_subsets(words, rank, t, r, [(x["sig"], x["places"]) for x in crowded])]

    return _map(classes, ["cls", "words", "crowded"], _SIG_SCHEMA, _SIG_ROW, make)


def frequent_words(classes: DataFrame) -> dict[str, int]:
    """{word: classes it stands in} of the frequent words; a bounded number (see FREQUENT_ONE_IN)."""
    n = classes.count()
    rows = classes.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= max(2, n // FREQUENT_ONE_IN)).collect()
    return {x["w"]: x["n"] for x in rows}


def _paired(left: DataFrame, right: DataFrame, t: float) -> DataFrame:
    """(a, b): what meets under a signature and may be similar by its sketch, smaller class first."""
    side = lambda df, c: df.select("sig", F.col("cls").alias(c), F.col("sk").alias(f"s{c}"), F.col("sk2").alias(f"s{c}2"))
    x, y = side(left, "x"), side(right, "y")
    return x.join(y, "sig").where(F.col("x") != F.col("y")).where(_may_be_similar("sx", "sy", t)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def near_duplicate_classes(classes: DataFrame, t: float = 0.7) -> DataFrame:
    """(kind, a, b, similarity): pairs of classes, a < b, whose word sets have a Jaccard similarity of t or more."""
    classes = stage(classes, "word_classes")
    variants = stage(_variant_rows(classes, t), "deletion_variants")
    load = variants.groupBy("sig").agg(F.count("*").alias("n"), F.count_if("whole").alias("wholes")).where((F.col("n") > 1) & (F.col("wholes") > 0))
    # Most variants meet none; those that do are used three times.
    met = stage(variants.join(load, "sig").select("sig", "whole", "cls", "sk", "sk2", (F.col("wholes") * F.col("n") > CROWD * CROWD).alias("crowded")), "met_variants")
    quiet = met.where("NOT crowded")
    # Every round's pairs are written at its end: one plan of all rounds would be large to no purpose.
    pairs = [stage(_paired(quiet.where("whole"), quiet, t), "met_pairs")]
    crowd = stage(met.where("crowded").select("cls").distinct(), "crowd")
    rank = frequent_words(classes)
    subsets, r = _subset_rows(classes.join(crowd, "cls", "left_semi"), rank, t), FEWEST_RARE
    while True:
        subsets = stage(subsets, "rare_subsets")
        load = subsets.groupBy("sig").agg(F.count("*").alias("n")).where("n > 1")
        met = stage(subsets.join(load, "sig"), "met_subsets")
        loud = met.where(F.col("n") > CROWD)
        # A set that need not share more than this subset pairs here; what it meets is similar, or nearly.
        first = met.where((F.col("n") <= CROWD) | F.col("done"))
        pairs.append(stage(_paired(first, met, t), "met_pairs"))
        # A class has few crowded subsets: no more than its rarest words give.
        still = stage(loud.where("NOT done").groupBy("cls").agg(F.collect_set(F.struct("sig", "places")).alias("crowded")), "crowded_subsets")
        if not still.take(1):
            break
        r += 1
        subsets = _extended_rows(classes.join(still, "cls"), rank, t, r)
    candidates = reduce(DataFrame.unionByName, pairs).distinct()
    w = classes.select("kind", "cls", F.transform("words", lambda x: F.xxhash64(x)).alias("h"))
    x, y = w.select(F.col("kind"), F.col("cls").alias("a"), F.col("h").alias("ha")), w.select(F.col("kind").alias("kind_b"), F.col("cls").alias("b"), F.col("h").alias("hb"))
    shared = F.size(F.array_intersect("ha", "hb"))
    return (
        candidates.join(x, "a").join(y, "b").where("kind = kind_b").select("kind", "a", "b", shared.alias("i"), (F.size("ha") + F.size("hb")).alias("n"))
        .where(F.col("i") >= F.lit(t) * (F.col("n") - F.col("i")) - 1e-9).select("kind", "a", "b", (F.col("i") / (F.col("n") - F.col("i"))).alias("similarity"))
    )


def member_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(kind, id_a, id_b): the pairs of records, smaller id first, of similar classes and within a class."""
    m = members.select("kind", "cls", "id")
    across = pairs.join(m.select("kind", F.col("cls").alias("a"), F.col("id").alias("x")), ["kind", "a"]).join(m.select("kind", F.col("cls").alias("b"), F.col("id").alias("y")), ["kind", "b"])
    within = m.withColumnRenamed("id", "x").join(m.withColumnRenamed("id", "y"), ["kind", "cls"]).where("x < y")
    return across.select("kind", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).unionByName(within.select("kind", F.col("x").alias("id_a"), F.col("y").alias("id_b")))


def near_duplicate_groups(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(kind, id, cls, grp, copies, links): each record's class, group, class size and its class's links.

    A class and a group go by their smallest record id.
    """
    nodes = members.select("kind", "cls").distinct()
    groups = components(pairs, nodes)
    degree = pairs.select("kind", F.col("a").alias("cls")).unionByName(pairs.select("kind", F.col("b").alias("cls"))).groupBy("kind", "cls").agg(F.count("*").alias("links"))
    sizes = members.groupBy("kind", "cls").agg(F.count("*").alias("copies"), F.min("id").alias("first"))
    of_class = sizes.join(degree, ["kind", "cls"], "left").join(groups, "cls").select("kind", "cls", "grp", "copies", "first", F.coalesce("links", F.lit(0)).alias("links"))
    leads = of_class.groupBy("grp").agg(F.min("first").alias("lead"))
    named = of_class.join(leads, "grp").select("kind", "cls", F.col("first").alias("name"), "lead", "copies", "links")
    return members.join(named, ["kind", "cls"]).select("kind", "id", F.col("name").alias("cls"), F.col("lead").alias("grp"), "copies", "links")
