"""Small tables with nulls, empties, ties, repeats and clashing columns for problems 1, 2, 7, 8 and 9."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import mixing, neighbours, packing, pairs, stuffing, tokens

PAIR = "pair_table string, pair_id string, question string, answer string, answerable boolean, words int"
PROSE = "Before the new tool was adopted the team tracked its open questions by hand and lost about {} hours for each release of {}."


def judged(spark, rows):
    df = spark.createDataFrame([("t", i, q, a, x, 1) for i, q, a, x in rows], PAIR)
    return {r.pair_id: r.defect for r in pairs.defective_pairs(df).collect()}


def test_defects(spark):
    question = "Which tool was used by Amon Brel when Kort had the ledger audited?"
    rows = [
        ("null", question, None, True), ("blank", question, " ​\n", True), ("na", question, "#N/A", None), ("dots", question, "...", True),
        ("copy", question, "Answer: " + question.upper(), True), ("twice", question, question + " " + question, True), ("restated", question, question + " It was Zelt.", True),
        ("refusal", question, "I'm sorry, but I can't help with that.", True), ("fr", "Pourquoi Amon a-t-il choisi ce projet avec Brel ?", "Désolé, je ne peux pas répondre à cette demande.", True),
        ("quoted", question, 'I quote the record: "Amon declined to sign off Kort while 80 checks were open."', True), ("sorry", question, "Sorry states in Kort mean a rejected load; Amon counted 57 of them.", True),
        ("german", question, "Weil die Listen von Amon nicht mehr ausreichten und Brel eine Prüfung für das Projekt brauchte.", True),
        ("cut", question, "The tool was Zelt, and it was chosen at", True), ("ellipsis", question, "The tool was Zelt, and it was cho…", True), ("short", question, "Zelt", True), ("number", question, "82", True),
        ("unasked", question, "I cannot answer this from the corpus.", False), ("noquestion", None, "The tool was Zelt.", True),
    ]
    # Refusals are told by their recurrence: the two templates above are met by unrelated prompts too.
    asks, fr = ["Who trained Dova in spring?", "When did Quil retire?", "Where does Hest load freight?", "How many ledgers are there?"], ["Combien de fiches restaient chez Dova ?", "Quand Quil est-il parti ?", "Où se trouve Hest ?", "Quel outil manquait ?"]
    more = [(f"en{i}", q, "I'm sorry, but I can't help with that.", True) for i, q in enumerate(asks)] + [(f"fr{i}", q, "Désolé, je ne peux pas répondre à cette demande.", True) for i, q in enumerate(fr)]
    got = judged(spark, rows + more)
    assert {got.pop(i) for i, *_ in more} == {"refusal"}
    assert got == {"null": "empty", "blank": "empty", "na": "empty", "dots": "empty", "copy": "question_copy", "twice": "question_copy", "refusal": "refusal", "fr": "refusal", "german": "other_language", "cut": "truncated", "ellipsis": "truncated"}
    assert judged(spark, []) == {}


def test_abstentions_are_learned_from_unanswerable_prompts(spark):
    rows = [(f"u{i}", f"{w} happened to case {i}?", "The files hold nothing on that point.", False) for i, w in enumerate(["What", "Who", "When", "Where", "Why", "How"])]
    rows.append(("asked", "Which tool did Amon use?", "The files hold nothing on that point.", True))
    assert judged(spark, rows) == {"asked": "refusal"}


def test_recurrence_reveals_refusals_in_any_words(spark):
    names = ["Amon", "Brel", "Kort", "Zelt", "Dova", "Quil", "Hest", "Jory"]
    asks = ["Which ledger did {} audit?", "Who trained {} in spring?", "When was {} retired?", "Where does {} load freight?", "Why did {} lose hours?", "How is {} checked?", "What replaced {} later?", "Whose budget paid {} staff?"]
    silent = "This desk stays silent whenever careers of {} come up."
    rows = [(f"silent{i}", a.format(n), silent.format(n), True) for i, (a, n) in enumerate(zip(asks, names))]
    # Sound answers: one template with another content each time, one fact asked in many ways, names as answers.
    rows += [(f"template{i}", a.format(n), f"The answer on record is that crew {names[i - 1]} rebuilt it.", True) for i, (a, n) in enumerate(zip(asks, names))]
    rows += [(f"same{i}", a.format("Kort"), "The older freight scanner gave way during winter trials.", True) for i, a in enumerate(asks)]
    rows += [(f"name{i}", a.format(n), "Zelt.", True) for i, (a, n) in enumerate(zip(asks, names))]
    assert judged(spark, rows) == {f"silent{i}": "refusal" for i in range(8)}


def test_one_evasive_answer_to_many_prompts(spark):
    names = ["Amon", "Brel", "Kort", "Zelt", "Dova", "Quil", "Hest", "Jory", "Mirl", "Pask", "Tove", "Wend"]
    asks = ["Which ledger did {} audit?", "Who trained {} in spring?", "When was {} retired?", "Why did {} lose hours?"]
    evasive = "Such matters stay with the people in charge of them and nothing further is said here."
    rows = [(f"evasive-{n}-{i}", a.format(n), evasive, True) for n in names for i, a in enumerate(asks)]
    # The answers of one form of question share a template, and what they say besides is the same.
    rows += [(f"sound-{n}-{i}", f"For what reason was crew {n} moved to yard {i}?", f"Because the old yard of {n} was flooded and the crane stood idle.", True) for n in names for i in range(4)]
    rows += [(f"other-{n}-{i}", a.format(n), f"The {names[i]} office holds entry {i}{j} on it.", True) for j, n in enumerate(names) for i, a in enumerate(asks)]
    assert judged(spark, rows) == {i: "refusal" for i, *_ in rows if i.startswith("evasive")}


def test_a_band_that_all_openings_share_is_compared_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(pairs, "TILE", 4)
    openings = [[1, *range(10, 25), 100 + i] for i in range(30)] + [[7, 8], [7, 9]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(openings)], "cls long, opening array<long>")
    got = {r.cls: r.grp for r in pairs.opening_clusters(df).collect()}
    assert {got[i] for i in range(30)} == {0} and got[30] == 30 and got[31] == 31


def brute_neighbours(vectors, k):
    out = {}
    for index in {i for i, _, _ in vectors}:
        own = {v: np.asarray(x, np.float64) for i, v, x in vectors if i == index}
        for a, x in own.items():
            sims = [(-round(float(x @ y / np.sqrt((x @ x) * (y @ y))), 6), b) for b, y in own.items() if b != a]
            out[index, a] = [b for _, b in sorted(sims)[:k]]
    return out


@pytest.mark.parametrize("block", [7, 2048])
def test_neighbours(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "STRIP", 5)
    rng = np.random.default_rng(3)
    rows = [("a", i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(60)]
    rows += [("a", 100 + i, rows[0][2]) for i in range(15)] + [("a", 200 + i, [2 * x for x in rows[1][2]]) for i in range(5)] + [("b", 300 + i, [float(i), 1.0]) for i in range(3)]
    bad = [("a", 900, None), ("a", 901, [1.0]), ("a", 902, [0.0] * 4), ("a", 903, [float("nan"), 1.0, 1.0, 1.0]), ("a", 904, [float("inf"), 1.0, 1.0, 1.0]), ("none", 905, [1.0] * 4), ("a", None, [1.0] * 4), rows[3]]
    df = spark.createDataFrame([(*r, 7) for r in rows + bad], "index_id string, vec_id long, vector array<float>, rep int")
    identity = spark.createDataFrame([("a", 4), ("b", 2), ("empty", 9)], "index_id string, dimension int")
    got = {}
    for r in neighbours.nearest(neighbours.usable_vectors(df, identity), k=5, block=block).orderBy("rank").collect():
        got.setdefault((r.index_id, r.vec_id), []).append(r.other_id)
    assert got == brute_neighbours(rows, 5)
    assert neighbours.nearest(neighbours.usable_vectors(df.limit(0), identity)).count() == 0


def test_recall_where_less_than_the_bounds_is_honoured(spark):
    rng = np.random.default_rng(9)
    rows = [("a", i, x.tolist()) for i, x in enumerate(rng.normal(size=(1200, 64)).astype(np.float32))]
    df = spark.createDataFrame(rows, "index_id string, vec_id long, v array<float>")
    want = brute_neighbours(rows, 10)
    for bound, least in ((1.0, 1.0), (0.25, 0.97), (0.0, 0.9)):
        got = {}
        for r in neighbours.nearest(df, bound=bound, block=300).collect():
            got.setdefault((r.index_id, r.vec_id), set()).add(r.other_id)
        recall = sum(len(got[key] & set(ids)) for key, ids in want.items()) / (10 * len(want))
        assert recall >= least, (bound, recall)


def test_packing(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([1, 5, 40, 300, 511, 512, 1300])) for i in range(400)] + [(900, None), (901, 0), (902, -4)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, tokens int, container string")
    parts = packing.cut_to_capacity(df, "doc_id", "tokens", 512)
    for rule, most, cost in (("norm", None, None), ("dot", None, None), ("norm", 3, 512.0**2)):
        packed = packing.pack(parts, 512, most, cost, rule, shards=2).toPandas()
        assert packed.part_size.sum() == sum(n for _, n in rows if n and n > 0)
        per = packed.groupby("container").part_size
        assert per.sum().max() <= 512 and (most is None or per.count().max() <= most)
        whole = packed.groupby("item").part.count()
        assert all(whole[i] == 1 for i, n in rows if n and 0 < n <= 512)
    # Parts over half a container need one each, and everything else fits beside them.
    assert packing.fill_report(packing.pack(parts, 512), 512).first().containers == parts.where("part_size > 256").count()
    assert packing.pack(parts.limit(0), 512).count() == 0 and packing.fill_report(packing.pack(parts.limit(0), 512), 512).first().containers == 0


def test_best_fit_obeys_every_capacity():
    sizes = sorted((random.Random(1).randrange(1, 60) for _ in range(500)), reverse=True)
    for rule in ("norm", "dot"):
        placed = packing.best_fit(sizes, 100, 4, 4000.0, rule=rule)
        for b in set(placed):
            inside = [n for n, c in zip(sizes, placed) if c == b]
            assert sum(inside) <= 100 and len(inside) <= 4 and (sum(n * n for n in inside) <= 4000 or len(inside) == 1)


def test_every_capacity_changes_the_packing():
    rng = random.Random(5)
    sizes = sorted((min(2048, max(1, round(rng.lognormvariate(5.5, 1.2)))) for _ in range(3000)), reverse=True)
    items, cost = packing.limits_for(2048, len(sizes), sum(sizes))
    for rule in ("norm", "dot"):
        full = packing.best_fit(sizes, 2048, items, cost, rule=rule)
        assert full != packing.best_fit(sizes, 2048, len(sizes), cost, rule=rule)
        assert full != packing.best_fit(sizes, 2048, items, 2048.0**2, rule=rule)
        assert sum(sizes) / 2048 / (max(full) + 1) > 0.98


def test_permutation_is_one():
    for size in (1, 2, 3, 10, 1000, 1025):
        x = mixing.permuted(np.arange(size), np.full(size, size), np.full(size, -77))
        assert sorted(x) == list(range(size))


def test_shards_draw_sources_at_random_and_use_every_block_alike():
    plan = {"a": (40, 400), "b": (700, 700), "c": (3, 5)}
    source, epoch, index = mixing.drawn_slots(np.arange(1105), plan, 7)
    assert np.bincount(source).tolist() == [400, 700, 5]
    assert all(sorted(index[(source == 0) & (epoch == e)]) == list(range(40)) for e in range(10))
    share = [(source[i : i + 100] == 0).mean() for i in range(0, 1100, 100)]
    assert 0.2 < min(share) < max(share) < 0.55
    far = mixing.drawn_slots(np.array([3 * 10**11]), {"a": (10**9, 4 * 10**11)}, 7)
    assert 0 <= far[1][0] < 400 and 0 <= far[2][0] < 10**9


def test_mixture(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", "c"]), rng.randrange(0, 90)) for i in range(300)] + [(900, "a", None), (901, None, 50)]
    df = spark.createDataFrame(rows, "doc_id long, kind string, tokens long")
    have = {k: sum(n for _, s, n in rows if s == k and n) for k in "abc"}
    plan = mixing.block_plan(have, {"a": (0.5, 2), "b": (0.3, 1), "c": (0.1, 3), "gone": (0.1, 9)}, 32)
    blocks = mixing.source_blocks(df.where("kind IS NOT NULL"), "doc_id", "kind", "tokens", 32, 300)
    mixed = mixing.mixture(blocks, plan, slots_per_shard=50).withColumn("n", F.col("token_end") - F.col("token_start")).toPandas()
    share = mixed.groupby("source").n.sum() / mixed.n.sum()
    assert abs(share["a"] - 0.5 / 0.9) < 0.02 and abs(share["b"] - 0.3 / 0.9) < 0.02 and abs(share["c"] - 0.1 / 0.9) < 0.02
    for source, most in (("a", 2), ("b", 1), ("c", 3)):
        uses = mixed[mixed.source == source].groupby(["doc", "token_start", "token_end"]).size()
        assert uses.max() <= most
    assert len(mixed.groupby(["shard", "slot"]).source.nunique().loc[lambda x: x > 1]) == 0
    assert mixing.mixture(blocks.limit(0), {}).count() == 0 and mixing.block_plan({}, {"a": (1.0, 1)}, 32) == {}


def test_tokens(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None), (3, ""), (4, "word " * 30_000)], "doc_id long, tokens_text string")
    got = {r.doc_id: r.tokens for r in tokens.with_tokens(df, "tokens_text", ["doc_id"]).collect()}
    assert got[2] == got[3] == 0 and got[1] == 3
    whole = tokens.encoding(tokens.TOKENIZERS, "byte_bpe_50k")
    assert got[4] == len(whole.encode_ordinary("word " * 30_000))


def test_stuffed_pages(spark):
    rng = random.Random(6)
    names = ["Amon", "Brel", "Kort", "Zelt", "Dova", "Quil", "Hest", "Jory"]
    verbs = [f"verb{i}" for i in range(400)]
    prose = [" ".join(PROSE.format(rng.randrange(999), rng.choice(names)) if rng.random() < 0.3 else "The " + " ".join(rng.sample(verbs, 6)) + " of the " + rng.choice(names) + " and a " + rng.choice(verbs) + " in it." for _ in range(9)) for _ in range(60)]
    spam = ["buy cheap jobs resume sql " * 30, "\n".join(f"https://x{i}.example/page/{i}" for i in range(30)), " ".join(f"#tag{i % 9}" for i in range(120))]
    rows = [(i, t) for i, t in enumerate(prose)] + [(100 + i, t) for i, t in enumerate(spam)] + [(200, None), (201, ""), (202, "§§§"), (203, "x" * 50_000)]
    df = spark.createDataFrame([(*r, "w") for r in rows], "doc_id long, text string, word string")
    got = {r.doc_id: r.kind for r in stuffing.stuffed_pages(stuffing.page_curves(df, "doc_id", "text")).collect()}
    assert {i: k for i, k in got.items() if k} == {100: "keywords", 101: "links", 102: "tags"}
    assert 200 not in got and {201, 202, 203} <= set(got)
    assert stuffing.stuffed_pages(stuffing.page_curves(df.limit(0), "doc_id", "text")).count() == 0


def kinds(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.kind for r in stuffing.stuffed_pages(stuffing.page_curves(df, "doc_id", "text")).collect() if r.kind}


def prose_pages(n):
    rng = random.Random(8)
    return [" ".join("The " + " ".join(rng.sample([f"verb{i}" for i in range(400)], 6)) + " of the team and a " + rng.choice(["ledger", "tool"]) + " in it." for _ in range(9)) for _ in range(n)]


def test_pages_of_rare_lengths_are_judged(spark):
    # One page of a length no other has, one of few words, and a table of few pages.
    rare = ["buy cheap jobs resume sql " * 2000, "buy cheap jobs buy cheap jobs"]
    assert kinds(spark, prose_pages(60) + rare) == {60: "keywords", 61: "keywords"}
    assert kinds(spark, prose_pages(12) + rare) == {12: "keywords", 13: "keywords"}


def test_links_count_in_any_layout(spark):
    urls = [f"https://x{i}.example/page/{i}" for i in range(3000)]
    caption = "A caption of so many words that it stands well over eighty characters away from the very link it names: "
    lists = [" ".join(urls[:40]), " | ".join(f"page {u}" for u in urls[:40]), " ".join(urls), (caption + urls[0] + "?q=" + "x" * 200 + " \n") * 9, "\n".join(u + " " + caption[:60] for u in (v + "/" + "y" * 90 for v in urls[:20]))]
    prose = "The team wrote at length of what the old tool did, as told at https://x1.example/a, before it was replaced by another one; more of that stands at https://x2.example/b and it was read by all of them. "
    assert kinds(spark, prose_pages(40) + lists + [prose]) == {40 + i: "links" for i in range(len(lists))}
