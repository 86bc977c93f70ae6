"""Pages of keywords, links or tags, told from prose by their rank-frequency curve.

Every page's tokens are counted, its frequency classes are ranked with a SQL window, and a line is fitted to
log frequency over log rank. Tokens are the words, and besides them the links (with their captions) and the
tags of a page, which are one token each however they read: in a list of links that token's rank, frequency
and mass are extreme. Slope, residual, the share of function words and the share of the text that repeated
content tokens make up are then held against the median and spread of pages of the same language and
comparable length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Frequent function words of the languages told apart here.
FUNCTION_WORDS = {
    "en": "the a an and or of to in on at by for from with as is are was were be been it its this that these those which who not no but if then than so we i you he she they his her their our my did does do has have had can could will would may must should into over under after before about between through during how what when where why there all any each both more most other some such only own same too very up down out off again once",
    "de": "der die das den dem des ein eine einen einem einer eines und oder von zu im in am an auf bei für mit als ist sind war waren sein es dies diese dieser dieses nicht kein keine aber wenn dann so wir ich sie er ihr ihre ihren sich auch noch nur nach vor über unter durch aus um bis wie was wann wo warum hat haben hatte werden wird wurde wurden zum zur vom beim",
    "fr": "le la les l un une des du de d et ou à au aux en dans sur par pour avec comme est sont était étaient être il elle ils elles ce cet cette ces que qui quoi dont ne pas plus mais si donc nous vous je on se sa son ses leur leurs y a ont avait été",
    "es": "el la los las un una unos unas y o de del al a en con por para como es son era eran ser se lo le les que quien cual no ni pero si entonces nos yo tú él ella ellos su sus este esta estos estas ese esa más muy ya ha han había fue fueron sin sobre entre",
}
# The tokens that all links and all tags of a page count as; no word has such characters.
LINK, TAG = "\x01", "\x02"
_LINK = r"(?:https?:)?//[^\s<>\"')\]]+|www\.[^\s<>\"')\]]+"
_TAG = r"#[\p{L}\p{N}_-]+"
# A line that is little else than a link and its caption.
_LINK_LINE = r"(?m)^.{0,80}?(?:(?:https?:)?//|www\.)\S+.{0,40}$"
# A link with the caption between it and the next link of its line.
_LINK_RUN = rf"(?:{_LINK})(?:.{{0,40}}?(?=(?:https?:)?//|www\.))?"
ANY_LANGUAGE = "*"


def _removed(text: Column, *patterns: str) -> Column:
    rest = text
    for pattern in patterns:
        rest = F.regexp_replace(rest, pattern, "")
    return F.length(text) - F.length(rest)


def _function_words(spark: SparkSession) -> DataFrame:
    """(word, mask): the function words, with a bit for every language that has them; a fixed table."""
    masks: dict[str, int] = {}
    for i, words in enumerate(FUNCTION_WORDS.values()):
        for w in words.split():
            masks[w] = masks.get(w, 0) | 1 << i
    return spark.createDataFrame(sorted(masks.items()), "word string, mask int")


def page_curves(pages: DataFrame, key: str, text: str) -> DataFrame:
    """One row per non-null page with the features of its rank-frequency curve.

    Columns: the key, n_chars, n_words (tokens), lang, slope, residual, function_share, repeat_share,
    link_share, tag_share (of the mass of all tokens). Rows under one key are taken as one page.
    """
    page = pages.where(F.col(text).isNotNull()).select(F.col(key).alias("page"), F.col(text).alias("t"))
    # One shuffle of the texts; all counting below then stays within its partition.
    page = page.repartition("page")
    t = F.col("t")
    has_link, has_tag = t.rlike(r"//|www\."), F.contains(t, F.lit("#"))
    rest = F.when(has_link, F.regexp_replace(F.regexp_replace(t, _LINK_LINE, " "), _LINK_RUN, " ")).otherwise(t)
    page = page.select(
        "page",
        F.length(t).alias("n_chars"),
        F.when(has_link, _removed(t, _LINK_LINE, _LINK_RUN)).otherwise(0).alias("link_chars"),
        F.when(has_tag, _removed(rest, _TAG)).otherwise(0).alias("tag_chars"),
        F.when(has_link, F.regexp_count(t, F.lit(_LINK))).otherwise(0).alias("links"),
        F.when(has_tag, F.regexp_count(rest, F.lit(_TAG))).otherwise(0).alias("tags"),
        F.when(has_tag, F.regexp_replace(rest, _TAG, " ")).otherwise(rest).alias("t"),
    )
    tokens = F.concat(F.split(F.lower("t"), r"[^\p{L}\p{N}]+"), F.array_repeat(F.lit(LINK), F.col("links")), F.array_repeat(F.lit(TAG), F.col("tags")))
    whole = page.select("page", "n_chars", "link_chars", "tag_chars", F.explode(tokens).alias("word"))
    # The empty string that split() leaves keeps pages without words in the table.
    words = whole.groupBy("page", "n_chars", "link_chars", "tag_chars", "word").agg(F.count("*").alias("n"))
    words = words.join(F.broadcast(_function_words(pages.sparkSession)), "word", "left").withColumn("mask", F.coalesce("mask", F.lit(0)))
    real, of_links, of_tags, function = F.col("word") != "", F.col("word") == LINK, F.col("word") == TAG, F.col("mask") > 0
    mass = F.when(of_links, F.col("link_chars")).when(of_tags, F.col("tag_chars")).otherwise(F.col("n") * F.length("word"))
    hits = [F.sum(F.when(F.col("mask").bitwiseAND(1 << i) > 0, F.col("n")).otherwise(0)).alias(f"in_{lang}") for i, lang in enumerate(FUNCTION_WORDS)]
    many = F.col("n") > 1
    classes = words.groupBy("page", "n_chars", "n").agg(
        F.sum(real.cast("int")).alias("m"),
        F.sum(F.when(function, F.col("n")).otherwise(0)).alias("functions"),
        F.sum(mass).alias("mass"),
        F.sum(F.when(~function & many, mass).otherwise(0)).alias("repeated"),
        F.sum(F.when(of_links & many, mass).otherwise(0)).alias("linked"),
        F.sum(F.when(of_tags & many, mass).otherwise(0)).alias("tagged"),
        *hits,
    )
    down = Window.partitionBy("page").orderBy(F.desc("n"))
    last = F.sum("m").over(down)
    ranked = classes.withColumn("rank", F.sqrt((last - F.col("m") + 1) * last.cast("double")))
    x, y = F.when(F.col("m") > 0, F.ln("rank")), F.when(F.col("m") > 0, F.ln("n"))
    total = F.sum(F.col("n") * F.col("m"))
    langs = list(FUNCTION_WORDS)
    best = F.greatest(*(F.sum(f"in_{g}") for g in langs))
    lang = F.lit(ANY_LANGUAGE)
    for g in reversed(langs):
        lang = F.when(F.sum(f"in_{g}") == best, F.lit(g)).otherwise(lang)
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    return ranked.groupBy("page", "n_chars").agg(
        total.alias("n_words"),
        F.when((best >= 3) & (best >= 0.1 * total), lang).otherwise(ANY_LANGUAGE).alias("lang"),
        F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("slope"),
        F.coalesce(F.sqrt(F.greatest(F.try_divide(F.regr_syy(y, x) - F.try_divide(F.pow(F.regr_sxy(y, x), F.lit(2)), F.regr_sxx(y, x)), F.regr_count(y, x)), F.lit(0.0))), F.lit(0.0)).alias("residual"),
        share(F.sum("functions"), total).alias("function_share"),
        share(F.sum("repeated"), F.sum("mass")).alias("repeat_share"),
        share(F.sum("linked"), F.sum("mass")).alias("link_share"),
        share(F.sum("tagged"), F.sum("mass")).alias("tag_share"),
    ).withColumnRenamed("page", key)


_FEATURES = ("slope", "residual", "function_share", "repeat_share")


def prose_norms(curves: DataFrame, min_pages: int = 30) -> DataFrame:
    """Median and spread of each feature by language and length class (word count to the power of two).

    Classes of fewer than ``min_pages`` pages are left out of a language; ``ANY_LANGUAGE`` has every length
    there is. Its smaller classes count by their pages, as a share of ``min_pages``, and for the rest the
    nearest class with enough pages does, or all pages together where none has.
    """
    sets = F.array_distinct(F.array(*(F.struct(g.alias("norm_lang"), c.alias("size_class")) for g, c in ((F.col("lang"), _size_class()), (F.lit(ANY_LANGUAGE), _size_class()), (F.lit(ANY_LANGUAGE), F.lit(None).cast("int"))))))
    quarter = lambda c: F.percentile_approx(c, [0.25, 0.5, 0.75], 1000)
    rows = curves.select(F.explode(sets).alias("s"), *_FEATURES).groupBy("s.norm_lang", "s.size_class").agg(F.count("*").alias("pages"), *(quarter(c).alias(c) for c in _FEATURES))
    rows = rows.select(
        "norm_lang", "size_class", "pages", *(F.col(c)[1].alias(f"{c}_mid") for c in _FEATURES), *(((F.col(c)[2] - F.col(c)[0]) / 1.35 + 0.02).alias(f"{c}_wide") for c in _FEATURES)
    )
    enough, every = F.col("pages") >= min_pages, F.col("norm_lang") == ANY_LANGUAGE
    norms = [c for c in rows.columns if c.endswith(("_mid", "_wide"))]
    peers = rows.where(every & (enough | F.col("size_class").isNull())).select(F.col("size_class").alias("peer"), F.struct(*norms).alias("near"))
    # All pages together have no length class: they are farther than any class.
    far = F.struct(F.coalesce(F.abs(F.col("peer") - F.col("size_class")), F.lit(1 << 20)), "peer")
    # Both sides are a row per length class: some thirty at most, lengths being powers of two.
    own = rows.where(every & F.col("size_class").isNotNull()).crossJoin(F.broadcast(peers)).groupBy("norm_lang", "size_class", "pages", *norms).agg(F.min_by("near", far).alias("near"))
    own_share = F.least(F.lit(1.0), F.col("pages") / min_pages)
    blended = own.select("norm_lang", "size_class", *((own_share * F.col(c) + (1 - own_share) * F.col("near")[c]).alias(c) for c in norms))
    return rows.where(~every & enough).select("norm_lang", "size_class", *norms).unionByName(blended)


def _size_class() -> Column:
    return F.floor(F.log2(F.greatest(F.col("n_words"), F.lit(8)))).cast("int")


def stuffed_pages(curves: DataFrame, far: float = 2.5, excess: float = 0.25, divergent: float = 0.4) -> DataFrame:
    """Curves with ``kind``: 'links', 'tags', 'keywords' or null.

    A page's divergence is the mass that its repeated content tokens (words, links, tags) take beyond the
    median of its peers: the total variation between the two splits of mass. A page is stuffed if it diverges
    by ``excess`` and its slope, residual or function-word share lies more than ``far`` spreads from its peers,
    or if it diverges by ``divergent``. Its kind is that of the tokens that make up most of the repeated mass.
    Links and tags must make up more than half of the page besides, as a list of them does; of keywords only
    those that recur are counted, so their mass falls short of theirs.
    """
    norms = prose_norms(curves)
    own = norms.withColumnRenamed("norm_lang", "lang")
    any_ = norms.where(F.col("norm_lang") == ANY_LANGUAGE).drop("norm_lang")
    any_ = any_.select("size_class", *(F.col(c).alias(f"any_{c}") for c in any_.columns if c != "size_class"))
    x = curves.withColumn("size_class", _size_class()).join(own, ["lang", "size_class"], "left").join(any_, "size_class", "left")
    mid = lambda c: F.coalesce(F.col(f"{c}_mid"), F.col(f"any_{c}_mid"))
    z = lambda c: (F.col(c) - mid(c)) / F.coalesce(F.col(f"{c}_wide"), F.col(f"any_{c}_wide"))
    divergence = F.coalesce(F.col("repeat_share") - mid("repeat_share"), F.lit(0.0))
    odd = F.coalesce((F.abs(z("slope")) > far) | (z("residual") > far) | (z("function_share") < -far), F.lit(False))
    stuffed = (divergence > divergent) | (divergence > excess) & odd
    words = F.col("repeat_share") - F.col("link_share") - F.col("tag_share")
    most = F.greatest("link_share", "tag_share", words)
    kind = F.when(F.col("link_share") == most, "links").when(F.col("tag_share") == most, "tags").otherwise("keywords")
    listed = (most == words) | (F.col("link_share") + F.col("tag_share") > 0.5)
    return x.select(*curves.columns, F.when(stuffed & listed, kind).alias("kind"))
