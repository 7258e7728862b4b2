"""Sharding, mixing, quality, chat, vectors, pages, components and the pipeline."""

from __future__ import annotations

import hashlib
import os
import random
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from partlog.llm import chat, html_text, mixing, near_vectors, quality, sharding
from partlog.llm.components import components
from partlog.llm.html_pages import labelled_pages

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, grp string, row int"


def documents(spark, rows):
    return spark.createDataFrame(
        [(i, t, "en" if (i or 0) % 3 else None, f"s{(i or 0) % 4}", len(t or ""), "g", 1) for i, t in rows],
        DOCS,
    )


def test_shards_are_even_and_keep_groups_together(spark):
    rng = random.Random(1)
    rows = [(i, f"text {i}") for i in range(300)]
    for k in range(40):
        rows += [(1000 + 10 * k + j, f"group {k}") for j in range(rng.randint(2, 6))]
    rows += [(5000 + j, "hot") for j in range(200)]
    rows += [(None, None), (7000, None), (7001, ""), (1, "text 1"), (1, "text 1")]
    found = sharding.assign_shards(documents(spark, rows).repartition(3), shards=8, keep=("lang",)).collect()
    assert len(found) == len(rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows
    )
    held = Counter(r["shard"] for r in found)
    assert set(held) == set(range(8)) and max(held.values()) - min(held.values()) <= 1
    for shard in range(8):
        assert sorted(r["slot"] for r in found if r["shard"] == shard) == list(range(held[shard]))
    text = {i: t for i, t in rows if i is not None}
    where = defaultdict(set)
    for r in found:
        if r["doc_id"] is not None and r["doc_id"] >= 1000 and r["doc_id"] < 5000:
            where[text[r["doc_id"]]].add(r["shard"])
    split = sum(len(s) > 1 for s in where.values())
    assert split <= 4  # 40 small groups, dealt at random before
    assert sharding.assign_shards(documents(spark, []), shards=8).collect() == []


def test_large_groups_are_cut_no_more_than_needed(spark):
    # 40 shards of 100: a third of all rows, some just below a shard, many of a fifth, small ones.
    sizes = [1333, 250] + [95] * 4 + [20] * 30 + [3] * 100
    rows = [(10**4 * k + j, f"group {k}") for k, n in enumerate(sizes) for j in range(n)]
    rows += [(10**7 + k, f"text {k}") for k in range(4000 - len(rows))]
    df = documents(spark, rows).repartition(3).withColumn("copy", F.md5("text"))
    placed = sharding.assign_shards(df, keep=("copy",)).cache()
    assert placed.count() == 4000
    assert {r["count"] for r in placed.groupBy("shard").count().collect()} == {100}
    where = defaultdict(Counter)
    for r in placed.collect():
        if r["doc_id"] < 10**7:
            where[r["doc_id"] // 10**4][r["shard"]] += 1
    parts = [sorted(where[k].values(), reverse=True) for k in range(len(sizes))]
    assert parts[:2] == [[100] * 13 + [33], [100, 100, 50]]
    assert all(p == [n] for p, n in zip(parts[2:], sizes[2:]))
    cut = sum(n * n - sum(x * x for x in p) for n, p in zip(sizes[:2], parts)) // 2
    edges = sum(n * (n - 1) // 2 for n in sizes)
    assert sharding.cut_edges(placed, "copy").collect() == [(edges, cut)]
    # Without documents that yield room, each border cuts one group at most.
    tight = documents(spark, [(3 * k + j, f"t {k}") for k in range(400) for j in range(3)])
    placed = sharding.assign_shards(tight.withColumn("copy", F.md5("text")), keep=("copy",))
    assert {r["count"] for r in placed.groupBy("shard").count().collect()} == {30}
    assert sharding.cut_edges(placed, "copy").head()["cut"] <= 3 * 39


def test_running_total_is_exact(spark):
    rows = [(k % 3, k % 5, k, k * k % 7) for k in range(200)]
    df = spark.createDataFrame(rows, "g int, p int, o int, a bigint")
    found = sharding.running_total(df, ["g"], [F.col("p"), F.col("o")], F.col("a"), 5, "before")
    for r in found.collect():
        want = sum(a for g, p, o, a in rows if g == r["g"] and (p, o) < (r["p"], r["o"]))
        assert r["before"] == want


def test_raking_meets_all_marginals(spark):
    rng = random.Random(2)
    cells = [
        (s, lang, t, rng.randint(100, 1000))
        for s in ("a", "b", None)
        for lang in ("x", "y")
        for t in ("p", "q", "r")
    ]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens bigint")
    raked = mixing.rake(df, budget=0.5, targets={"lang": {"x": 1.0, "y": 1.0}}).collect()
    total = sum(c[3] for c in cells)
    assert all(0 <= r["weight"] <= r["tokens"] for r in raked)
    for lang in ("x", "y"):
        have = sum(r["weight"] for r in raked if r["lang"] == lang)
        assert have == pytest.approx(total / 4, rel=2e-3)
    tempered = {
        s: sum(c[3] for c in cells if c[0] == s) ** mixing.TEMPER for s in ("a", "b", None)
    }
    for s, share in tempered.items():
        have = sum(r["weight"] for r in raked if r["source"] == s)
        assert have == pytest.approx(total / 2 * share / sum(tempered.values()), rel=2e-3)


def test_mixing_draws_by_probability(spark):
    rows = [(i, " ".join(["w"] * (i % 50 + 1))) for i in range(3000)]
    rows += [(None, None), (1, ""), (2, " \t"), (5, "a  b\nc")]
    mixed = mixing.mix(documents(spark, rows).withColumn("weight", F.lit("old"))).collect()
    assert len(mixed) == len(rows)
    assert {r["n_tokens"] for r in mixed if (r["text"] or "").strip() == ""} == {0}
    assert [r["n_tokens"] for r in mixed if r["text"] == "a  b\nc"] == [3]
    expected = sum(r["probability"] * r["n_tokens"] for r in mixed)
    total = sum(r["n_tokens"] for r in mixed)
    assert expected == pytest.approx(mixing.BUDGET * total, rel=0.01)
    assert sum(r["n_tokens"] for r in mixed if r["kept"]) == pytest.approx(expected, rel=0.05)
    assert mixing.mix(documents(spark, [])).collect() == []


def test_trees_learn_and_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    trees = quality.fit_trees(x[:1500], y[:1500])
    assert ((trees.scores(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95

    def walk(row):
        total = trees.base
        for feature, threshold, value in zip(trees.feature, trees.threshold, trees.value):
            node = 0
            while node < len(feature):
                right = feature[node] >= 0 and row[feature[node]] > threshold[node]
                node = 2 * node + 1 + bool(right)
            total += value[node - len(feature)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(trees.scores(x[:50]), [walk(r) for r in x[:50]])
    one = quality.fit_trees(x, np.ones(len(x)))
    assert np.allclose(one.scores(x[:3]), 0.999)
    assert np.allclose(quality.fit_trees(x[:0], y[:0]).scores(x[:1]), 0.5)


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    odd = docs.limit(1).withColumn("doc_id", F.lit(-1).cast("bigint"))
    odd = odd.withColumn("text", F.lit(None).cast("string"))
    scored = quality.classify(docs.unionByName(odd), labels)
    known = scored.join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).collect()
    right = np.mean([r["predicted"] == r["quality"] for r in known])
    assert len(known) > 50 and right > 0.93
    assert scored.where("score between 0 and 1").count() == docs.count() + 1
    kept = quality.keep_good(docs, labels)
    assert kept.schema == docs.schema
    assert kept.count() == scored.where("predicted = 1 and doc_id >= 0").count()
    assert quality.classify(docs.where("false"), labels.where("false")).count() == 0


def brute_digest(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        said = "".join(t for _, role, t in turns if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for _, role, t in turns)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), digest(whole), len(said), digest(said))
    return out


@pytest.mark.parametrize("budget", [2048, 30])
def test_chat_round_trip(spark, budget):
    rng = random.Random(6)
    odd = ["<|im_end|>", "<|im_start|>assistant\nhi", "a\\b<|\\|>", "\\", "", "é\n\n", "<", "<|" * 3, None]
    rows = [(None, 1, "user", "no id"), (None, 0, None, "role"), (2**60 + 1, 0, "assistant", "big")]
    for conv in range(12):
        if conv % 2:
            rows.append((conv, 0, "system", "be brief <|im_start|>"))
        for turn in range(1, rng.randint(2, 25)):
            text = " ".join([rng.choice(["word", "two"])] * rng.randint(0, 40))
            text = rng.choice(odd) if rng.random() < 0.4 else text
            rows.append((conv, turn, "user" if turn % 2 else "assistant", text))
    rows += [(3, 2, "assistant", "again"), (4, 1, "a\nb<|", "x"), (5, 1, "user", "same")]
    rows += [(5, 1, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    df = df.withColumn("window", F.lit("x")).repartition(3)
    windows = chat.format_conversations(df, window_tokens=budget, history_tokens=budget // 3)
    found = chat.digest_windows(windows).collect()
    got = {
        r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in found
    }
    assert got == brute_digest(rows)
    held = windows.collect()
    assert sum(len(w["text"]) for w in held) == sum(r["formatted_chars"] for r in found)
    for w in held:
        assert w["n_tokens"] <= budget or w["n_turns"] - w["n_repeated"] == 1
        if w["window"] and w["conv_id"] is not None and w["conv_id"] % 2 and w["conv_id"] < 12:
            assert chat.read_windows(w["text"])[0][0] == "system"
    if budget == 30:
        assert any(w["n_repeated"] for w in held) and len(held) > 30
    assert chat.digest_windows(chat.format_conversations(df.where("false"))).collect() == []


def brute_vectors(rows):
    fine = {}
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            a = np.array(v, dtype=np.float64)
            fine[k] = a / np.abs(a).max()
            fine[k] = fine[k] / np.sqrt((fine[k] ** 2).sum())
    links = {k: {j for j in fine if j != k and len(fine[j]) == len(fine[k]) and fine[j] @ fine[k] >= 0.9} for k in fine}
    out = []
    for k, (name, _) in enumerate(rows):
        reach, todo = {k}, [k]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in reach:
                    reach.add(j)
                    todo.append(j)
        least = min(rows[j][0] for j in reach)
        out.append((name, len(links.get(k, ())), least, name == least))
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 16])
def test_vectors_match_brute_force(spark, block):
    rng = np.random.default_rng(7)
    rows, centres = [], rng.normal(size=(8, 16))
    for i in range(160):
        c = centres[rng.integers(8)]
        rows.append((i, (c + rng.normal(size=16) * rng.choice([0.0, 0.3, 0.55])).astype(np.float32).tolist()))
    rows += [(200, None), (201, []), (202, [0.0] * 16), (203, [1.0] * 15 + [None])]
    rows += [(204, [float("nan")] * 16), (205, [float("inf")] + [0.0] * 15), (206, [1.0, 0.0]), (207, [2.0, 0.1])]
    rows += [(208, (centres[0] * 1e30).tolist()), (209, [0.0, 1.0]), (210, [-0.0, 3.0])]
    rows += [(300 + k, rows[0][1]) for k in range(20)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, class string")
    found = near_vectors.link_vectors(df.repartition(3), block=block).collect()
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in found)
    assert got == brute_vectors(rows) and sum(r[1] for r in got) > 100
    assert near_vectors.link_vectors(df.where("false")).collect() == []


def test_rounds_of_small_blocks_match_brute_force(spark):
    rng = np.random.default_rng(9)
    rows, centres = [], {w: rng.normal(size=(4, w)) for w in (16, 24)}
    for i in range(150):
        w = 24 if i % 5 == 0 else 16
        v = centres[w][rng.integers(4)] + rng.normal(size=w) * rng.choice([0.0, 0.3, 0.45])
        rows.append((i, (v.astype(np.float32) if i % 2 else v).tolist()))
    rows += [(150 + k, [10.0 ** (300 - k), 1.0]) for k in range(3)] + [(160, None), (161, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    assert -(-sum(len(v or []) == 16 for _, v in rows) // near_vectors.GROWN) > near_vectors.SENT
    before = spark.conf.get(near_vectors.REMOVE_SHUFFLES)
    found = near_vectors.link_vectors(df, block=1).collect()
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in found)
    assert got == brute_vectors(rows) and sum(r[1] for r in got) > 100
    assert spark.conf.get(near_vectors.REMOVE_SHUFFLES) == before


def test_each_pair_of_blocks_meets_once_in_all_rounds(spark):
    rows = [(k, 1, 2, 9, [k + 1.5, 2.0**-60]) for k in range(200)]
    df = spark.createDataFrame(rows, "class bigint, members bigint, width int, blocks int, v array<double>")
    met, per_round = Counter(), []
    for k in range(3):
        sent = near_vectors._sent(df, 3, k).collect()
        for r in sent:
            assert r["at"] in (r["i"], r["j"]) and len(r["vectors"]) <= near_vectors.PIECE_BYTES
            met.update((r["i"], r["j"], r["at"], c) for c in r["classes"])
        per_round.append(sum(len(r["classes"]) for r in sent))
    at = {c: b for _, _, b, c in met}
    assert len(at) == 200 and set(met.values()) == {1} and sum(per_round) == 200 * 9
    assert max(per_round) <= 200 * 4
    assert {(i, j) for i, j, _, _ in met} == {(i, j) for i in range(9) for j in range(i, 9)}


@pytest.mark.parametrize("width, noise", [(64, 0.33), (64, 0.05), (1100, 0.33)])
def test_tiles_of_dense_groups_match_brute_force(width, noise):
    rng = np.random.default_rng(10)
    v = rng.normal(size=width) + noise * rng.normal(size=(2100, width))
    u = v / np.sqrt((v * v).sum(1, keepdims=True))
    ids, members = np.arange(2100) + 7, rng.integers(1, 4, 2100)
    a, b = ((ids[of], members[of], near_vectors._Quantised(v[of])) for of in (slice(0, 1300), slice(1300, 2100)))
    for x, y, same in ((a, b, False), (a, a, True)):
        links = u[x[0] - 7] @ u[y[0] - 7].T >= 0.9
        if same:
            np.fill_diagonal(links, False)
        found = near_vectors._tile(x, y, 0.9, same)
        got = dict(zip(found["class"][found["linked"] > 0], found["linked"][found["linked"] > 0]))
        want = dict(zip(x[0], links @ y[1])) | ({} if same else dict(zip(y[0], links.T @ x[1])))
        assert got == {c: n for c, n in want.items() if n}
        forest = found[found["linked"] == 0]
        top = {c: c for c in [*x[0], *y[0]]}
        for c, d in zip(forest["class"], forest["other"]):
            assert links[c - x[0][0], d - y[0][0]]
            while top[c] != c:
                c = top[c]
            while top[d] != d:
                d = top[d]
            assert c != d
            top[c] = d
        i, j = np.nonzero(links)
        for c, d in zip(x[0][i[:5000]], y[0][j[:5000]]):
            while top[c] != c:
                c = top[c]
            while top[d] != d:
                d = top[d]
            assert c == d


LOW_MEMORY = """
import sys
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
sys.path.insert(0, sys.argv[1])
from partlog.llm import near_vectors
conf = {"spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.sql.shuffle.partitions": "2"}
spark = SparkSession.builder.master("local[2]").config(map=conf).getOrCreate()
value = lambda k: F.pmod(F.xxhash64(F.col("id") % 8000, k), F.lit(2001)).cast("float") - 1000 + F.col("id") / 8000
df = spark.range(0, 8192, 1, 4).select(
    F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(1024)), value).alias("embedding"))
found = near_vectors.link_vectors(df)
print("FOUND", found.count(), found.where("n_links = 1").count(), found.where("kept").count())
"""


def test_vectors_that_fill_the_heap_are_linked():
    # All blocks that one task sent were held in memory at once: 64 MB of vectors failed.
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--driver-memory 512m pyspark-shell"}
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    said = subprocess.run([sys.executable, "-c", LOW_MEMORY, repo], env=env, capture_output=True, text=True, timeout=900)
    assert "FOUND 8192 384 8000" in said.stdout, said.stderr[-2000:]


def test_quantised_bounds_hold():
    rng = np.random.default_rng(8)
    raw = [rng.normal(size=32).astype("<f8").tobytes() for _ in range(200)]
    q = near_vectors._Quantised(raw)
    about = (q.codes @ q.codes.T) * q.scale[:, None] * q.scale[None, :]
    bound = q.size[:, None] * q.loss[None, :] + q.loss[:, None] * (q.size + q.loss)[None, :]
    assert (np.abs(q.unit @ q.unit.T - about) <= bound + near_vectors.ROUNDING).all()


def test_components_of_chains_stars_and_loops(spark):
    links = [(k, k + 1) for k in range(100, 220)] + [(1, k) for k in range(2, 60)] + [(7, 7), (500, 501), (501, 500)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    found = {r["node"]: r["component"] for r in components(df).collect()}
    want = {k: 100 for k in range(100, 221)} | {k: 1 for k in range(1, 60)} | {500: 500, 501: 500}
    assert found == want
    assert components(df.where("false")).collect() == []


ARTICLE = "<article><h1>Head &amp; more</h1><p><b>A first line.<br><p>Ti.</p><p>Long &eacute;t&eacute; text, with\n\n a <a href=x>link</a>, that goes on for quite a while and says a lot of things.</p></article>"
TEXT = "Head & more\n\nA first line.\n\nTi.\n\nLong été text, with a link, that goes on for quite a while and says a lot of things."


@pytest.mark.parametrize(
    "around",
    [
        "<html><body><nav><ul><li><a href='/a'>Menu</a></li></ul></nav>{}<footer>&copy; us</footer></body></html>",
        "<script>var t='<p>no</p>';</script><style>p{{}}</style><div class=\"ad\">Buy a very long and good thing today, or tomorrow, or never, it is up to you.</div>{}",
        "<header><h1>Site</h1></header><!-- <p>no</p> -->{}<aside><h3>Related</h3><p>Other things that you may want to read next.</p></aside>",
        "<div class='cookie-notice'><p>We use cookies and other things to make this page work for you.</p></div>{}<section id='comments'><h2>Comments</h2><div class='comment'><p>I think that this is wrong, and I will tell you why at some length.</p></div></section>",
        "<form><label>Name</label><input name=q><button>Send</button></form>{}",
        "<div><div>{}</div></div><div class=sidebar><ul><li><a>x</a></li></ul></div>",
    ],
)
def test_pages(around):
    model = html_text.train()
    assert html_text.main_text(around.format(ARTICLE), model) == TEXT


def test_broken_pages_and_marginals(spark):
    model = html_text.train()
    for page in ("<", "<p", "<p class='x", "</p></div></x>", "<!--", "<script>", "&", "&am", "<p>" * 3000, "<a href=\"" * 50):
        html_text.main_text(page, model)
    assert html_text.main_text("", model) == "" and html_text.main_text(None, model) == ""
    rows = [(1, "u", ARTICLE, "x"), (None, None, None, "x"), (1, "u", ARTICLE, "x"), (2, "v", "", "x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    found = sorted(((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html_text.extract_main_text(df).collect()))
    assert found == [(0, "", 0), (1, TEXT, len(TEXT)), (1, TEXT, len(TEXT)), (2, "", 0)]
    assert html_text.extract_main_text(df.where("false")).collect() == []


def test_messages_give_exact_marginals():
    """Sums over all labellings of a small tree."""
    model = html_text.train()
    tree = html_text.parse("<div class='post'><p>Some text of a page</p><a>x</a></div>")
    size = len(tree.tag)
    text = [n for n in range(size) if not tree.tag[n]]
    links = html_text._links(tree)
    total, main = 0.0, np.zeros(size)
    for code in range(3**size):
        label = [code // 3**n % 3 for n in range(size)]
        weight = 1.0
        for n in range(size):
            if tree.tag[n]:
                weight *= model._element(tree.tag[n], tree.hint[n])[label[n]]
            else:
                weight *= (*model._text(html_text._length(tree.text[n]), links[n])[0][:2], 0.0)[label[n]]
            if n:
                weight *= model.edge[html_text._kind(tree.tag[n])][label[tree.parent[n]]][label[n]]
        total += weight
        main += weight * (np.array(label) == html_text.MAIN)
    found = model.marginals(tree)
    assert [found[n] for n in text] == pytest.approx([main[n] / total for n in text])


def test_labelled_pages_are_learned():
    model, right, total = html_text.train(), 0, 0
    for page in labelled_pages():
        tree, labels = html_text._marked(page)
        for n, p in enumerate(model.marginals(tree)):
            if not tree.tag[n]:
                total += 1
                right += (p >= 0.5) == (labels[n] == html_text.MAIN)
    assert right / total > 0.98


def test_pipeline(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    sizes, left = [], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, left, d)
        assert out.columns == docs.columns, name
        rows = {r["doc_id"] for r in out.collect()}
        assert rows <= {r["doc_id"] for r in left.select("doc_id").collect()}
        sizes.append(len(rows))
        left = docs.where(F.col("doc_id").isin(sorted(rows)))
    assert sizes == sorted(sizes, reverse=True) and sizes[0] < docs.count() and sizes[-1] > 50
    placed = corpus_pipeline.run(spark, d)
    assert {r["doc_id"] for r in placed.collect()} == rows
    held = Counter(r["shard"] for r in placed.collect())
    assert max(held.values()) - min(held.values()) <= 1
