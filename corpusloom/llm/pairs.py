"""Defective prompt and response pairs, each with its one defect.

Response openings are masked (names and numbers), shingled and clustered by MinHash with a verified Jaccard
similarity. A template that recurs across unrelated prompts and tells all of them the same, or that mostly
answers prompts without an answer, is a refusal, whatever its words: no list of phrases is searched. Copies
are found on the words, languages on function words, and a response that does not end counts as truncated if
the words it ends on do not end responses elsewhere in the table.

Words travel as 64-bit hashes; shingles, signatures, comparisons and contexts are arrays of numbers.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.components import components
from corpusloom.llm.stuffing import FUNCTION_WORDS
from corpusloom.runtime import stage

DEFECTS = ("empty", "question_copy", "refusal", "other_language", "truncated")

# Responses that stand for none at all, without case, punctuation and markup.
PLACEHOLDERS = set("na n/a none null nil nan undefined tbd tba todo blank empty missing pending unknown answer void noanswer noresponse notavailable notapplicable keineantwort keineangabe ka sinrespuesta ninguno ninguna aucune aucunereponse ras so xxx lorem br p placeholder".split())
# Labels that may stand before a copied question.
LABELS = set("q a question answer response reply prompt query output frage antwort pregunta respuesta reponse réponse r f p de the to".split())
# Closed-class words of each language (question words, pronouns, conjunctions, prepositions,
# auxiliaries, quantifiers), beside FUNCTION_WORDS.
_MORE_WORDS = {
    "en": "whose whom whilst while because since until unless whether although though against without within across among toward upon per than too also yet ever never every many much few less least another either neither nobody nothing anyone someone something anything everything everyone me him us myself himself herself itself themselves am being cannot let get got gets",
    "de": "warum wieso weshalb welche welcher welches welchem welchen wer wen wem wessen wie viele wieviel bei hat haben nachdem bevor weil während dass ob damit dazu daran darauf dabei dafür deshalb daher erst alle allen alles noch mehr viel etwas nichts jemand niemand jeder jede jedes jeden einige andere anderen sehr schon immer hier dort dann denn doch sonst zwischen gegen ohne seit konnte kann können musste muss müssen sollte sollten soll wollte gewesen wäre würde mich mir dich dir uns euch ihm ihnen seine seinen seiner seinem ihrem ihrer einmal",
    "fr": "pourquoi combien chez quand lequel laquelle lesquels afin après avant car selon depuis aucun aucune cette parce encore étaient toujours jamais rien tout tous toute toutes très moins aussi alors ainsi puis lors entre sans sous vers dès jusque lui moi toi eux celui celle ceux celles mon ma mes ton ta tes notre nos votre vos peu beaucoup trop chaque quelque quelques même autre autres fut furent sera serait peut pouvait doit devait il n s d c j qu",
    "es": "cuánto cuántos cuánta cuántas cuándo cómo quién quiénes cuál cuáles cuando porque hasta desde después antes según cada ya mucho muchos poco todo todos toda todas otro otra otros otras mismo misma nada algo alguien nadie nunca siempre también tampoco aunque mientras donde contra hacia durante tras mediante debe deben debía debían puede pueden podía podían tiene tienen tenía tenían está están estaba estaban hay había hubo sido siendo me nos mi mis aquel aquella aquellos eso esto ello",
}
# Words that do not end a sentence.
_UNFINISHED = set(
    "the a an and or of to as because than that which who whose whom if when while where as from into such namely including via per between during since until unless although its their his her my our your and/or is are was were be been has have had will would can could should must "
    "und oder der die das den dem des ein eine einen einem einer eines zu zum zur von vom mit für bei nämlich sowie wie weil dass als im am ist war sind "
    "et ou le la les l un une de du des d à au aux par pour avec que qui notamment comme dont dans sur sous chez est sont "
    "y o el los las una del en con por para que como entre sobre sin desde hasta su sus al es son".split()
)
# Pairs of words that do not end a sentence.
_UNFINISHED_PAIRS = {"together with", "in turn", "because of", "such as", "as well", "zusammen mit", "en raison", "debido a", "junto con", "avec la", "grâce à"}
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_PLAIN = re.compile(r"[^\W_]+")
_INVISIBLE = re.compile(r"[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
_MARKUP = re.compile(r"<[^<>]*>|&nbsp;|&#\d+;")
#: Words of an opening; words of a shingle; similarity of openings in one cluster.
OPENING, SHINGLE, SIMILAR = 16, 5, 0.8
#: Context words an ending is judged by, at most.
CONTEXT = 6
#: MinHash rows of a band, and bands; openings of one band compared with each other in one step.
ROWS, BANDS, TILE = 3, 8, 512
#: Context words counted in a task before their sums leave it.
_HELD = 1 << 21
#: Responses of fewer words are not judged by their context: short answers need no full stop.
SHORT = 6
#: Share of a cluster that must tell the same, and the share of prompts by which a word may exceed chance.
ALIKE, RELATED = 0.6, 0.2
#: Content words that an answer has beside its prompt's, at least, for their recurrence to count.
TOLD = 2


def _tell_apart(words: dict[str, str]) -> dict[str, str]:
    """{word: language} of the words that only one language has."""
    lists = {g: set(FUNCTION_WORDS[g].split()) | set(words[g].split()) for g in words}
    return {w: g for g, ws in lists.items() for w in ws if sum(w in other for other in lists.values()) == 1}


_LANGUAGE_OF = _tell_apart(_MORE_WORDS)
_FUNCTION = {w for g in _MORE_WORDS for w in (FUNCTION_WORDS[g] + " " + _MORE_WORDS[g]).split()}


def language(text: str, words: list[str]) -> tuple[str | None, int]:
    """The language whose own function words lead among ``words`` (lower-cased), and by how many; other
    scripts go by their name."""
    if not text.isascii():
        letters = [c for c in text if c.isalpha()]
        foreign = [c for c in letters if c > "ɏ" and not unicodedata.name(c, "LATIN").startswith("LATIN")]
        if len(foreign) > 0.5 * len(letters):
            return unicodedata.name(foreign[0], "OTHER").split()[0].replace("HIRAGANA", "CJK").replace("KATAKANA", "CJK"), len(foreign)
    hits: dict[str, int] = {}
    for w in words:
        g = _LANGUAGE_OF.get(w)
        if g:
            hits[g] = hits.get(g, 0) + 1
    if not hits:
        return None, 0
    best = max(hits, key=lambda g: (hits[g], g))
    return best, hits[best] - max((n for g, n in hits.items() if g != best), default=0)


def is_empty(answer: str | None) -> bool:
    """Nothing, nothing visible, or only a placeholder."""
    if answer is None:
        return True
    t = _INVISIBLE.sub("", _MARKUP.sub(" ", answer)).strip()
    bare = "".join(_PLAIN.findall(t.lower()))
    return not bare or bare in PLACEHOLDERS


def is_copy(q: list[str], a: list[str]) -> bool:
    """Only the question again: no words but the question's and labels, and nearly all of the question's."""
    if not q or len(a) < 0.6 * len(q):
        return False
    qs = set(q)
    extra = [w for w in a if w not in qs]
    return all(w in LABELS for w in extra) and len(extra) <= 3 * max(1, round(len(a) / len(q))) and len(qs - set(a)) <= 0.2 * len(qs)


def masked(text: str) -> list[str]:
    """Words with numbers as '9' and capitalised words as 'N' (but for the first, kept in lower case)."""
    return ["9" if w[0].isdigit() else "N" if i and w[0].isupper() else w.lower() for i, w in enumerate(_WORD.findall(text))]


def content(words: list[str]) -> set[str]:
    """Lower-cased words but for function words and single letters."""
    return {w for w in words if len(w) > 1 and w not in _FUNCTION}


def told(asked: set[str], said: set[str]) -> str | None:
    """The content words an answer adds to its prompt's; null if they are few or hold a number."""
    new = said - asked
    return " ".join(sorted(new)) if len(new) >= TOLD and not any(c.isdigit() for w in new for c in w) else None


def ending(answer: str) -> str:
    """'whole' (closed by a mark), 'broken' (by what only a break leaves), or 'open' (neither)."""
    t = _INVISIBLE.sub("", answer).rstrip()
    if not t:
        return "whole"
    if t.endswith(("…", "...", ",", ";", "(", "[", "“", "„", "«", "/", "&", " -", "–", "—")):
        return "broken"
    if t[-1] in ".!?。！？:" or (t[-1] in "\"”»)]'’" and len(t) > 1 and t[-2] in ".!?。！？"):
        return "whole"
    last = _PLAIN.findall(t)
    if len(last) > 1 and last[-1].lower() in _UNFINISHED and not last[-1].isupper():
        return "broken"
    if len(last) > 2 and " ".join(last[-2:]).lower() in _UNFINISHED_PAIRS:
        return "broken"
    return "open"


class _Hashes(dict):
    """Signed 64-bit hashes of words, each computed once a task; forgotten when there are very many."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 1 << 20:
            self.clear()
        x = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        x = self[word] = x - (1 << 64) if x >> 63 else x
        return x

    def all(self, words: list[str]) -> list[int]:
        return [self[w] for w in words]


_FACTS = "pair_table string, pair_id string, answerable boolean, prompt long, empty boolean, copy boolean, foreign boolean, ending string, cased boolean, words array<long>, opening array<long>, cls long, told long, tongue long, topics array<long>"
_SENTENCE, _AFTER = re.compile(r"(?<=[.!?])\s"), re.compile(r"\?\W*")


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, flag, many = pa.int64(), pa.bool_(), pa.list_(pa.int64())
    h = _Hashes()

    def prompt(asked: list[str], tongue: str | None) -> tuple[int, list[int]]:
        """The prompt's language and its distinct words, each with the language in its hash."""
        own = h[tongue or ""]
        return own, [x ^ own for x in h.all(sorted(set(asked)))]

    for b in batches:
        rows = []
        for q, a in zip(b.column("question").to_pylist(), b.column("answer").to_pylist()):
            q = q or ""
            asked = _PLAIN.findall(q.lower())
            lq, _ = language(q, asked)
            if is_empty(a):
                rows.append((0, True, False, False, "whole", False, [], [], 0, None, *prompt(asked, lq)))
                continue
            # After a restated question only what follows it is judged.
            words = masked(_AFTER.split(a)[-1] or a)
            said = _PLAIN.findall(a.lower())
            la, by = language(a, said)
            opening = ["^", *masked(_SENTENCE.split(a.strip(), maxsplit=1)[0])[:OPENING]]
            new = told(content(asked), content(said))
            last = _WORD.findall(a[-200:])
            rows.append((
                h[" ".join(masked(q[:200])[:4])], False, is_copy(asked, said), bool(lq and la and lq != la and by >= 2), ending(a), bool(last) and last[-1][0].islower(),
                h.all(words), h.all(opening), h[" ".join(opening)], h[new] if new else None, *prompt(asked, lq),
            ))
        columns = list(zip(*rows)) if rows else [[]] * 12
        kinds = (number, flag, flag, flag, pa.string(), flag, many, many, number, number, number, many)
        yield pa.RecordBatch.from_arrays([b.column("pair_table"), b.column("pair_id"), b.column("answerable"), *(pa.array(list(c), t) for c, t in zip(columns, kinds))], names=[f.split(" ")[0] for f in _FACTS.split(", ")])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column end to end, and the place where each list begins (and the last ends)."""
    edges = column.offsets.to_numpy()
    return column.flatten().to_numpy().view(np.uint64), edges - edges[0]


def _chained(words: np.ndarray, room: np.ndarray, longest: int) -> Iterator[np.ndarray]:
    """For n = 1, 2 ... ``longest`` the hashes of the n words that end at each place; only where ``room`` (the
    words before a place in its own list) is n - 1 or more do they mean anything."""
    key = np.zeros(len(words), np.uint64)
    for n in range(longest):
        with np.errstate(over="ignore"):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + np.r_[np.zeros(min(n, len(words)), np.uint64), words[: max(0, len(words) - n)]] + np.uint64(n + 1))
        yield key


def shingles(openings: list[np.ndarray]) -> list[np.ndarray]:
    """The distinct shingles of each opening; one shorter than a shingle is one shingle."""
    size = np.array([len(x) for x in openings])
    flat = np.concatenate(openings) if len(openings) else np.zeros(0, np.uint64)
    start = np.cumsum(size) - size
    room = np.arange(len(flat)) - np.repeat(start, size)
    keys = list(_chained(flat, room, SHINGLE))
    out = []
    for s, n in zip(start.tolist(), size.tolist()):
        out.append(np.unique(keys[SHINGLE - 1][s + SHINGLE - 1 : s + n]) if n >= SHINGLE else keys[n - 1][s + n - 1 : s + n] if n else np.zeros(0, np.uint64))
    return out


def _signer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seeds = _mix(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for b in batches:
        flat, edges = _flat(b.column("opening"))
        sets = shingles([flat[i:j] for i, j in zip(edges, edges[1:])])
        size = np.array([len(s) for s in sets], np.int64)
        if not size.sum():
            continue
        with np.errstate(over="ignore"):
            low = np.minimum.reduceat(_mix(np.concatenate(sets)[:, None] ^ seeds), np.cumsum(size) - size, axis=0)
            bands = np.zeros((len(sets), BANDS), np.uint64)
            for r in range(ROWS):
                bands = _mix(bands + low[:, r::ROWS] + np.arange(BANDS, dtype=np.uint64))
        many = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("cls"), pa.array([s.view(np.int64) for s in sets], many), pa.array(list(bands.view(np.int64)), many)], names=["cls", "shingles", "bands"])


def _alike(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Whether each of ``x`` and each of ``y`` have a Jaccard similarity of SIMILAR or more."""
    nx, ny = np.array([len(s) for s in x]), np.array([len(s) for s in y])
    keys, at = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    held = np.zeros((len(x) + len(y), len(keys)), np.float32)
    held[np.repeat(np.arange(len(held)), np.r_[nx, ny]), at] = 1
    shared = held[: len(x)] @ held[len(x) :].T
    return shared >= SIMILAR * (nx[:, None] + ny - shared) - 1e-4


def _linker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the openings of one unit; rows come sorted by band and unit, a tile's two sides together."""
    unit, sides = None, ([], [])

    def links() -> Iterator[pa.RecordBatch]:
        (row, col) = sides
        if unit is None or not row or (unit[1] != unit[2] and not col):
            return
        other = col if unit[1] != unit[2] else row
        if len(row) == len(other) == 1 and other is row:
            return
        i, j = np.nonzero(_alike([s for _, s in row], [s for _, s in other]))
        a, b = np.array([c for c, _ in row])[i], np.array([c for c, _ in other])[j]
        keep = a < b if other is row else a != b
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    for batch in batches:
        flat, edges = _flat(batch.column("shingles"))
        cols = [batch.column(c).to_pylist() for c in ("band", "i", "j", "own", "cls")]
        for band, i, j, own, cls, s, e in zip(*cols, edges, edges[1:]):
            if unit != (band, i, j):
                yield from links()
                unit, sides = (band, i, j), ([], [])
            sides[0 if own == i else 1].append((cls, flat[s:e].copy()))
    yield from links()


def opening_clusters(openings: DataFrame) -> DataFrame:
    """(cls, grp): distinct openings grouped by MinHash over shingles, candidates verified by Jaccard.

    ``openings`` has cls (the hash) and opening (its words' hashes, at least one), repeated as they come.
    Openings that share a band are compared in tiles of TILE by TILE, so a band that a third of all openings
    share becomes many small units of work; a tile emits the links that hold, never its pairs.
    """
    o = openings.groupBy("cls").agg(F.first("opening").alias("opening"))
    o = stage(o.mapInArrow(_signer, "cls long, shingles array<long>, bands array<long>"), "openings")
    banded = o.select("cls", "shingles", F.explode(F.array_distinct("bands")).alias("band"))
    sizes = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    dealt = banded.join(sizes, "band").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int"))
    met = dealt.select("band", "cls", "shingles", "own", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    met = met.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls", "shingles")
    links = met.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(_linker, "a long, b long")
    return components(links, o.select("cls"))


def _topic_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for b in batches:
        held.append(_flat(b.column("topics"))[0])
        n += len(held[-1])
        if n >= _HELD:
            yield _counted(held)
            held, n = [], 0
    if n:
        yield _counted(held)


def _counted(held: list[np.ndarray]) -> pa.RecordBatch:
    topic, n = np.unique(np.concatenate(held), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(topic.view(np.int64)), pa.array(n)], names=["topic", "everywhere"])


def told_alike(facts: DataFrame, clustered: DataFrame, prompts: int, often: int) -> DataFrame:
    """(grp): clusters that tell unrelated prompts alike, whatever their wording.

    Most of the cluster (ALIKE) adds the same to its prompts, ``often`` times or more, to ``prompts`` kinds of
    prompts or more. The prompts are unrelated if no word stands in a larger share of them than in prompts of
    that language at large, but for RELATED and the error of a share. Sound answers share a template but differ
    in what they add, or answer questions about one thing or of one form.
    """
    said = clustered.groupBy("grp", "told").agg(F.count("*").alias("n"), F.approx_count_distinct("prompt").alias("kinds"))
    sizes = said.groupBy("grp").agg(F.sum("n").alias("size"))
    often_told = said.where(F.col("told").isNotNull() & (F.col("n") >= often) & (F.col("kinds") >= prompts))
    most = often_told.join(sizes, "grp").where(F.col("n") >= ALIKE * F.col("size")).select("grp", "told", "n")
    rows = clustered.select("grp", "told", "tongue", "topics").join(most, ["grp", "told"]).select("grp", "n", "tongue", "topics")
    here = rows.groupBy("grp", "tongue").agg(F.count("*").alias("asked"))
    seen = rows.select("grp", "n", "tongue", F.explode("topics").alias("topic")).groupBy("grp", "n", "tongue", "topic").agg(F.count("*").alias("at"))
    counts = facts.select("topics").mapInArrow(_topic_counter, "topic long, everywhere long").join(seen.select("topic").distinct(), "topic", "left_semi").groupBy("topic").agg(F.sum("everywhere").alias("everywhere"))
    tongues = facts.groupBy("tongue").agg(F.count("*").alias("whole"))
    by_chance = F.col("asked") * F.col("everywhere") / F.col("whole")
    excess = seen.join(here, ["grp", "tongue"]).join(counts, "topic").join(tongues, "tongue").groupBy("grp", "n").agg(F.max((F.col("at") - by_chance) / F.col("n")).alias("excess"))
    return excess.where(F.col("excess") <= RELATED + 0.5 / F.sqrt("n")).select("grp")


def defective_pairs(pairs: DataFrame, prompts: int = 3, often: int = 4) -> DataFrame:
    """(pair_table, pair_id, defect): one row per defective pair.

    ``pairs`` has pair_table, pair_id, question, answer and answerable, one row per pair; pairs with
    answerable = false are learned from but never reported, null counts as answerable. A pair has the first
    of DEFECTS that it shows. A refusal is a response whose opening's cluster tells unrelated prompts alike
    (``prompts`` kinds of prompts, ``often`` times), or answers so many prompts and mostly such as have no
    answer. A refusal whose template does not recur so often is not told from an answer. Null questions make neither copies nor other languages.
    """
    facts = stage(pairs.select("pair_table", "pair_id", F.coalesce("answerable", F.lit(True)).alias("answerable"), "question", "answer").mapInArrow(_facts, _FACTS), "pair_facts")
    said = facts.where(~F.col("empty") & ~F.col("copy"))
    clusters = opening_clusters(said.select("cls", "opening"))
    clustered = stage(said.join(clusters, "cls").select("pair_table", "pair_id", "answerable", "prompt", "grp", "told", "tongue", "topics"), "clustered")
    per = clustered.groupBy("grp").agg(F.count("*").alias("n"), F.approx_count_distinct("prompt").alias("prompts"), F.count_if(~F.col("answerable")).alias("unanswerable"))
    refusing = per.where((F.col("prompts") >= prompts) & (F.col("n") >= often) & (2 * F.col("unanswerable") >= F.col("n"))).select("grp")
    alike = told_alike(facts, clustered, prompts, often)
    refused = clustered.where("answerable").join(refusing.unionByName(alike), "grp", "left_semi")
    # Every check adds the rows it holds of; of a pair's defects the first counts.
    place = lambda name: F.lit(DEFECTS.index(name))
    seen = F.when(F.col("empty"), place("empty")).when(F.col("copy"), place("question_copy")).when(F.col("foreign"), place("other_language")).when(F.col("ending") == "broken", place("truncated"))
    found = (
        facts.where("answerable").select("pair_table", "pair_id", seen.alias("at")).where("at IS NOT NULL")
        .unionByName(refused.select("pair_table", "pair_id", place("refusal").alias("at")))
        .unionByName(broken_endings(facts).select("pair_table", "pair_id", place("truncated").alias("at")))
    )
    first = found.groupBy("pair_table", "pair_id").agg(F.min("at").alias("at"))
    return first.select("pair_table", "pair_id", F.element_at(F.array(*(F.lit(d) for d in DEFECTS)), F.col("at") + 1).alias("defect"))


def _contexts(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(size, room, keys) of responses' words, each response led by a mark of its beginning: its number of words
    with the mark, and for every place the words before it and the hashes of the contexts that end there."""
    flat, edges = _flat(words)
    size = np.diff(edges) + 1
    led = np.insert(flat, edges[:-1], np.uint64(1))
    room = np.arange(len(led)) - np.repeat(np.cumsum(size) - size, size)
    return size, room, list(_chained(led, room, CONTEXT))


def _endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        size, room, keys = _contexts(b.column("words"))
        last = np.cumsum(size) - 1
        for n, key in enumerate(keys, 1):
            at = np.flatnonzero(size >= n)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(at)) for c in ("pair_table", "pair_id", "cased")), pa.array((size[at] - 1).astype(np.int32)), pa.array(np.full(len(at), n, np.int32)), pa.array(key[last[at]].view(np.int64))], names=["pair_table", "pair_id", "cased", "size", "n", "key"])


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "seen", "ended", "closed", "elsewhere"]
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def flush() -> pa.RecordBatch:
        key, kind = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(key, kind="stable")
        key, kind = key[order], kind[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        # Kinds of place: 0 inside, 1 at a broken end, 2 at an open end, 3 at a whole end.
        sums = [np.add.reduceat(x.astype(np.int64), first) for x in (np.ones(len(key)), kind >= 2, kind == 3, (kind == 0) | (kind == 3))]
        return pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), *map(pa.array, sums)], names=names)

    for b in batches:
        size, room, keys = _contexts(b.column("words"))
        at_end = {"broken": 1, "open": 2, "whole": 3}
        kind = np.zeros(len(room), np.int8)
        kind[np.cumsum(size) - 1] = [at_end[e] for e in b.column("ending").to_pylist()]
        for i, key in enumerate(keys):
            ok = (room >= i) & (room > 0)
            held.append((key[ok], kind[ok]))
            n += int(ok.sum())
        if n >= _HELD:
            yield flush()
            held, n = [], 0
    if n:
        yield flush()


def broken_endings(facts: DataFrame, support: int = 8, ends: float = 0.1, closes: float = 0.2) -> DataFrame:
    """(pair_table, pair_id): the answerable pairs whose open ending breaks off.

    An open ending stops short if its longest context seen ``support`` times or more ends responses less than
    ``ends`` of those times, unless one of three words or more is closed by a mark in ``closes`` of its other
    places; and if its last word (in lower case) stands nowhere but at ends without a mark. Contexts are summed
    up within a task before they are shuffled.
    """
    full = facts.where(~F.col("empty"))
    opened = full.where((F.col("ending") == "open") & F.col("answerable")).select("pair_table", "pair_id", "cased", "words")
    wanted = stage(opened.mapInArrow(_endings, "pair_table string, pair_id string, cased boolean, size int, n int, key long"), "open_endings")
    sums = full.select("words", "ending").mapInArrow(_counter, "key long, seen long, ended long, closed long, elsewhere long")
    counts = sums.join(wanted.select("key").distinct(), "key", "left_semi").groupBy("key").agg(*(F.sum(c).alias(c) for c in ("seen", "ended", "closed", "elsewhere")))
    enough = F.when(F.col("seen") >= support, F.col("n"))
    judged = wanted.join(counts, "key").groupBy("pair_table", "pair_id", "cased", "size").agg(
        F.max_by("ended", enough).alias("ended"),
        F.max_by("seen", enough).alias("seen"),
        F.max((F.col("n") >= 3) & (F.col("closed") > 0) & (F.col("closed") >= closes * (F.col("seen") - 1))).alias("closes"),
        F.max(F.when(F.col("n") == 1, F.col("elsewhere"))).alias("elsewhere"),
    )
    short = (F.col("size") >= SHORT) & ~F.col("closes") & F.coalesce(F.col("ended") < ends * F.col("seen"), F.lit(False))
    partial = F.col("cased") & (F.coalesce("elsewhere", F.lit(0)) == 0)
    return judged.where(short | partial).select("pair_table", "pair_id")
