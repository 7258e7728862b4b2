"""Clashing column names, hostile pages, tight budgets, short items and targets that cannot be met."""

from __future__ import annotations

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from partlog.llm import chat, decontamination, html_text, licenses, mixing, sharding


def benchmark(spark, items):
    return spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")


def plain_tiles(item, doc, least):
    """Greedy string tiling by its definition, on lists of words."""
    free = [[True] * len(item), [True] * len(doc)]
    out = []
    while True:
        best = 0
        found = []
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and free[0][i + n] and free[1][j + n]:
                    n += 1
                if n >= max(least, best):
                    found = found if n == best else []
                    best = n
                    found.append((i, j))
        if not found:
            return out
        for i, j in found:
            if all(free[0][i : i + best]) and all(free[1][j : j + best]):
                free[0][i : i + best] = free[1][j : j + best] = [False] * best
                out.append((i, j, best))


@pytest.mark.parametrize("seed", range(3))
def test_tiles_match_the_definition(spark, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcd")
    items = [[word() for _ in range(rng.randint(3, 14))] for _ in range(6)]
    docs = [[word() for _ in range(rng.randint(3, 30))] for _ in range(12)]
    df = spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(docs)], "doc_id bigint, text string")
    found = decontamination.tiles(df, benchmark(spark, [" ".join(i) for i in items]), seed_words=3, block_words=20)
    got = {(r["doc_id"], r["item_id"]): (r["covered"], r["longest"], r["n_tiles"]) for r in found.collect()}
    want = {}
    for d, doc in enumerate(docs):
        for i, item in enumerate(items):
            tiles = plain_tiles(item, doc, 3)
            if tiles:
                want[d, i] = (sum(n for *_, n in tiles), max(n for *_, n in tiles), len(tiles))
    assert got == want and len(want) > 20


def test_short_items_and_repeated_words(spark):
    items = benchmark(spark, ["Yes it is!", "...", " ".join(["same"] * 200)])
    docs = spark.createDataFrame(
        [(1, "yes, it IS"), (2, "Yes it is so"), (3, " ".join(["same"] * 8000)), (4, "..."), (5, "")],
        "doc_id bigint, text string",
    )
    start = time.time()
    found = {(r["doc_id"], r["item_id"], r["covered"]) for r in decontamination.tiles(docs, items).collect()}
    assert found == {(1, 0, 3), (3, 2, 200)}
    assert time.time() - start < 60


def test_decontamination_keeps_all_columns(spark):
    item = " ".join(f"w{n}" for n in range(20))
    docs = spark.createDataFrame(
        [(1, item, 0.7, 5, "a", "b", True), (2, "clean", 0.9, 6, "c", "d", False)],
        "doc_id bigint, text string, coverage double, item_id bigint, _key string, _doc string, contaminated boolean",
    )
    left = decontamination.decontaminate(docs, benchmark(spark, [item]))
    assert [tuple(r) for r in left.collect()] == [(2, "clean", 0.9, 6, "c", "d", False)]
    judged = decontamination.judged(docs, benchmark(spark, [item])).orderBy("doc_id").collect()
    assert [(r["contaminated"], r["item_id"], r["coverage"], r["_key"]) for r in judged] == [(True, 0, 1.0, "a"), (False, None, 0.0, "c")]


def test_mixing_keeps_all_columns(spark):
    docs = spark.createDataFrame(
        [(k, f"text number {k}", "s", "l", f"t{k % 2}", 7.5, "old") for k in range(50)],
        "doc_id bigint, text string, source string, lang string, topic string, weight double, kept string",
    )
    found = corpus_pipeline.source_mixing(spark, docs, "")
    assert found.columns == docs.columns
    rows = found.collect()
    assert 0 < len(rows) < 50 and {(r["weight"], r["kept"]) for r in rows} == {(7.5, "old")}
    marked = {r["doc_id"] for r in mixing.mix(docs).where("kept").collect()}
    assert {r["doc_id"] for r in rows} == marked


def test_targets_that_cannot_be_met_are_reported(spark):
    cells = spark.createDataFrame(
        [("a", "x", "t", 100), ("b", "y", "t", 100)], "source string, lang string, topic string, tokens bigint"
    )
    targets = {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.1, "y": 0.9}}
    raked = mixing.rake(cells, 0.5, targets)
    errors = {(r["margin"], r["value"]): r for r in mixing.margin_errors(cells, raked, 0.5, targets).collect()}
    assert errors["source", "a"]["want"] == pytest.approx(90)
    assert max(r["off"] for r in errors.values()) > 0.5
    fine = {"source": {"a": 0.6, "b": 0.4}}
    again = mixing.rake(cells, 0.5, {**fine, "lang": {"x": 0.6, "y": 0.4}})
    both = {**fine, "lang": {"x": 0.6, "y": 0.4}}
    assert max(r["off"] for r in mixing.margin_errors(cells, again, 0.5, both).collect()) < 1e-2


def test_sharding_keeps_columns_of_any_name(spark):
    names = ["size", "row", "grp", "shard", "members", "text_crc32", "slot", "law", "start", "_piece", "other"]
    docs = spark.createDataFrame([(k, f"t{k % 7}") for k in range(200)], "doc_id bigint, text string")
    docs = docs.select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id")).alias(c) for c in names])
    rows = corpus_pipeline.label_sharding(spark, docs, "").collect()
    assert len(rows) == 200 and {r["law"] for r in rows} == {"rows"}
    held = Counter(r["shard"] for r in rows)
    assert max(held.values()) - min(held.values()) <= 1
    for r in rows:
        assert r["given_size"] == f"size-{r['doc_id']}" and r["row"] == f"row-{r['doc_id']}"
        assert r["given_shard"] == f"shard-{r['doc_id']}" and r["other"] == f"other-{r['doc_id']}"


@pytest.mark.parametrize("budget", [60, 200])
def test_windows_stay_within_the_budget(spark, budget):
    rng = random.Random(budget)
    rows = []
    for conv in range(20):
        if conv % 2:
            rows.append((conv, 0, "system", " ".join(["rule"] * rng.choice([3, 20, 2 * budget]))))
        for turn in range(1, 15):
            rows.append((conv, turn, "assistant" if turn % 2 else "user", " ".join(["w"] * rng.randint(0, budget))))
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    windows = chat.format_conversations(df, window_tokens=budget, history_tokens=budget // 2).collect()
    assert any(w["n_repeated"] > 1 for w in windows)
    for w in windows:
        turns = chat.read_windows(w["text"])
        sizes = [chat.count_tokens(t) + chat.count_tokens(role) + 2 for role, t in turns]
        assert w["n_tokens"] == sum(sizes)
        # A system turn that is repeated, and the first turn that is not, have to fit.
        system = sizes[0] if w["window"] and turns[0][0] == "system" else 0
        assert system <= budget
        if system + sizes[w["n_repeated"]] <= budget:
            assert w["n_tokens"] <= budget


def test_letters_whose_lower_case_is_longer_move_no_text():
    model = html_text.train()
    body = "".join(f"<p>Sentence number {n} of an article that has enough words in it.</p>" for n in range(5))
    for n in (1, 5, 200):
        page = f"<html><body><div>{'İ' * n}</div><script>var a = '</p>';</script><article><h1>The heading</h1>{body}</article></body></html>"
        text = html_text.main_text(page, model)
        assert text.startswith("The heading\n\nSentence number 0") and "cle>" not in text


@pytest.mark.parametrize(
    "page",
    [
        "<a " * 350_000,
        "<b>" * 100_000 + "</i>" * 100_000,
        "<p>" + "<b>" * 50_000 + "<div></div>" * 50_000,
        '<a x=">" ' * 100_000,
        "<div>" * 100_000,
        "<" * 500_000,
        "<ul><li>" * 50_000 + "</li>" * 50_000,
    ],
)
def test_hostile_pages_take_linear_time(page):
    start = time.time()
    html_text.parse(page)
    assert time.time() - start < 20


def test_cut_edges_fall_from_round_to_round(spark):
    """A third of all rows in one group, some of a fifth of a shard, many small ones."""
    rng = random.Random(3)
    sizes = [1_300] + [60] * 10 + [25] * 20 + [rng.randint(2, 9) for _ in range(150)]
    quotas = [100] * 40
    rows = []
    for g, n in enumerate(sizes):
        parts = Counter(rng.randrange(40) for _ in range(n))
        rows += [(f"g{g}", n, label, here) for label, here in parts.items()]
    counts = spark.createDataFrame(rows, "grp string, members bigint, start int, here bigint")
    found, cuts = sharding.propagate(counts, quotas, 4)
    assert len(cuts) > 4 and all(a > b for a, b in zip(cuts, cuts[1:]))
    # The large group fills 13 shards at best, and then cuts (1300^2 - 13 * 100^2) / 2 edges.
    best = (1_300**2 - 13 * 100**2) // 2
    assert cuts[-1] - best < 0.8 * (cuts[0] - best)
    held, whole = Counter(), Counter()
    for r in found.collect():
        held[r["start"]] += r["here"]
        whole[r["grp"]] += r["here"]
    assert max(held.values()) <= 100 and whole == Counter({f"g{g}": n for g, n in enumerate(sizes)})
    small = [r["here"] == r["members"] for r in found.collect() if r["members"] < 10]
    assert sum(small) > 0.7 * 150


def test_one_header_is_not_three_licenses(spark):
    gpl, agpl = licenses.TEMPLATES["GPL-header"], licenses.TEMPLATES["AGPL-header"]
    docs = spark.createDataFrame(
        [(1, f"start {gpl} end"), (2, f"{agpl} and {gpl}"), (3, f"{gpl} {licenses.TEMPLATES['MIT']}")],
        "doc_id bigint, text string",
    )
    best, all_ = {}, {}
    for r in licenses.scan(docs).collect():
        all_.setdefault(r["doc_id"], set()).add(r["template"])
        if r["best"]:
            best.setdefault(r["doc_id"], set()).add(r["template"])
    assert best == {1: {"GPL-header"}, 2: {"GPL-header", "AGPL-header"}, 3: {"GPL-header", "MIT"}}
    assert len(all_[1]) > 1
