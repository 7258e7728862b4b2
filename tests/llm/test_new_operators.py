"""Token counts, whitening and spelling variants against plain computations."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from partlog.llm import spelling, token_counts, whitening
from partlog.llm.token_counts import TokenCache, Tokenizer, count_tokens

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

TEXTS = [
    (1, "The cat sat, didn't it?  Yes\n\n  it did. "),
    (2, "  Ünïcödé — 漢字 и текст \U0001f600"),
    (3, None),
    (4, ""),
    (5, "a <|endoftext|> b<|endoftext|>"),
    (6, "The cat sat, didn't it?  Yes\n\n  it did. "),
    (6, "The cat sat, didn't it?  Yes\n\n  it did. "),
    (None, "no id"),
    (None, "no id"),
    (7, "word " * 3000),
    (8, "x" * 5000),
    (9, " \t\n\r\x0b "),
]


def documents(spark, rows):
    return spark.createDataFrame(
        [(i, t, "z", 7, 8) for i, t in rows],
        "doc_id bigint, text string, digest string, n_tokens int, n bigint",
    )


def counted(docs, tokenizer, cache):
    rows = count_tokens(docs, tokenizer, cache).collect()
    return Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows)


def test_counts_are_those_of_the_library_and_misses_are_encoded_once(spark, tmp_path):
    tokenizer, cache = Tokenizer.load(BYTES), TokenCache(f"{tmp_path}/cache")
    library = tokenizers.Tokenizer.from_file(BYTES)
    n = {t: len(library.encode(t or "", add_special_tokens=False)) for _, t in TEXTS}
    want = Counter((i, len((t or "").encode()), n[t], n[t] > 1024) for i, t in TEXTS)
    docs = documents(spark, TEXTS).repartition(4)
    assert counted(docs, tokenizer, cache) == want
    stored = cache.counts(spark, tokenizer)
    assert stored.count() == stored.distinct().count() == len({t or "" for _, t in TEXTS})

    # A second run takes all from the cache, also for other ids, and appends nothing.
    before = sorted(p.name for p in (tmp_path / "cache").rglob("*.parquet"))
    again = documents(spark, [((i or 0) + 100, t) for i, t in TEXTS])
    assert sum(r[2] for r in counted(again, tokenizer, cache).elements()) == sum(n[t] for _, t in TEXTS)
    assert sorted(p.name for p in (tmp_path / "cache").rglob("*.parquet")) == before

    # Only what is new is encoded; a digest that was stored twice counts once.
    cache.append(cache.counts(spark, tokenizer), tokenizer)
    more = documents(spark, [*TEXTS, (50, "one more")])
    assert counted(more, tokenizer, cache) == want + Counter([(50, 8, 2, False)])
    assert cache.counts(spark, tokenizer).distinct().count() == len({t or "" for _, t in TEXTS}) + 1


def test_a_stored_count_is_used_for_its_tokenizer_only(spark, tmp_path):
    bytes_, pieces = Tokenizer.load(BYTES), Tokenizer.load(PIECES)
    assert bytes_.digest != pieces.digest
    cache = TokenCache(f"{tmp_path}/cache")
    docs = documents(spark, [(1, "The cat sat")])
    wrong = token_counts.digested(docs).select("digest", F.lit(77).cast("bigint").alias("n_tokens"))
    cache.append(wrong, bytes_)
    assert list(counted(docs, bytes_, cache)) == [(1, 11, 77, False)]
    n = len(sentencepiece.SentencePieceProcessor(model_file=PIECES).encode("The cat sat"))
    assert list(counted(docs, pieces, cache)) == [(1, 11, n, False)]
    assert counted(documents(spark, []), pieces, cache) == Counter()
    assert counted(documents(spark, []), pieces, TokenCache(f"{tmp_path}/none")) == Counter()


def test_many_misses_move_by_a_join(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "NAMED_ROWS", 3)
    tokenizer = Tokenizer.load(BYTES)
    library = tokenizers.Tokenizer.from_file(BYTES)
    rows = [(k % 70, f"text {k % 40} of many") for k in range(400)] + [(5, "hot")] * 200
    want = Counter((i, len(t), len(library.encode(t)), False) for i, t in rows)
    assert counted(documents(spark, rows).repartition(5), tokenizer, TokenCache(f"{tmp_path}/c")) == want


def test_long_texts_have_the_tokens_of_their_pieces():
    rng = random.Random(3)
    parts = ["word", " ", "  ", "\n", "'s", "é", "12", "<|endoftext|>", "?!", " ", "　", " a"]
    library = tokenizers.Tokenizer.from_file(BYTES)
    for _ in range(60):
        text = "".join(rng.choice(parts) for _ in range(400))
        cut = list(token_counts.pieces(text, 20))
        assert "".join(cut) == text and len(cut) > 2
        assert sum(len(library.encode(p)) for p in cut) == len(library.encode(text))
    assert token_counts._cuts_at_spaces(open(BYTES, "rb").read())
    assert not token_counts._cuts_at_spaces(open(public_tokenizers.path("word_bpe_49k.json"), "rb").read())


# ---- whitening ----


def solved(a, most):
    width = a.shape[1]
    r = np.linalg.qr(a, mode="r")
    r = np.concatenate([r, np.zeros((width - len(r), width))])
    return whitening.directions(r, most)


@pytest.mark.parametrize("seed", range(4))
def test_solver_agrees_with_a_dense_one(seed):
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.standard_normal((40, 40)))
    close = np.ones(40)
    close[:4] += np.array([1, 2, 3, 4]) * 1e-6
    small = rng.integers(-2, 3, (rng.integers(1, 30), 9)) * rng.choice([0, 1, 1], 9)
    for a in (
        rng.standard_normal((300, 24)),
        rng.standard_normal((3, 24)),
        rng.standard_normal((200, 24)) * np.logspace(0, -9, 24),
        np.concatenate([rng.standard_normal((80, 10))] * 2, axis=1),
        q * 3,
        q * close @ q.T,
        np.diag([3.0, 3, 2, 2, 1, 0]),
        np.zeros((4, 4)),
        small.astype(float),
    ):
        values, found = solved(a, a.shape[1])
        want = np.linalg.svd(a, compute_uv=False)
        want = np.concatenate([want, np.zeros(a.shape[1] - len(want))])
        top = max(want[0], 1e-300)
        assert np.abs(values - want).max() <= 1e-13 * top
        large = want > 1e-10 * top
        assert np.abs(values[large] / want[large] - 1).max(initial=0) < 1e-11
        assert len(found) == np.linalg.matrix_rank(a)
        assert np.abs(a.T @ (a @ found.T) - found.T * values[: len(found)] ** 2).max(initial=0) <= 1e-12 * top**2
        assert np.abs(found @ found.T - np.eye(len(found))).max(initial=0) < 1e-10


def vectors(spark, rows):
    return spark.createDataFrame(
        [(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<double>, x string"
    )


def test_whitened_vectors_agree_with_a_dense_eigensolver(spark):
    rng = np.random.default_rng(5)
    rows = [(k, list(map(float, v))) for k, v in enumerate(rng.standard_normal((300, 6)) * [5, 3, 2, 1, 0.5, 0.1])]
    rows += [(k + 1000, rows[7][1]) for k in range(150)]  # copies: a third of all rows
    odd = [(2000, None), (2001, [1.0] * 5 + [None]), (2002, [math.nan] * 6), (2003, [math.inf] * 6)]
    odd += [(2004, [1.0]), (2005, []), (2006, [1e300] * 6)]
    rows += [(None, rows[3][1]), (2**62, rows[4][1]), (5, rows[5][1])]
    found = whitening.whiten(vectors(spark, rows + odd).repartition(7)).collect()
    assert len(found) == 4 * len(rows)
    x = [(i, tuple(math.floor(256 * c) for c in v)) for i, v in rows]
    fit = sorted({v for _, v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array(fit) - np.array(sums) / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    got = defaultdict(list)
    for r in found:
        got[r["vec_id"], r["component"]].append(r)
        assert r["n"] == n and r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(e[r["component"] - 1] / e.sum(), rel=1e-9)
    deviation = {i: sum((n * a - s) ** 2 for a, s in zip(v, sums)) for i, v in x}
    assert all(r["deviation"] == deviation[r["vec_id"]] for r in found)
    for c in range(4):
        want = {i: (np.array(v) - np.array(sums) / n) @ u[:, c] / math.sqrt(e[c]) for i, v in x}
        one = max(want, key=lambda i: abs(want[i]))
        sign = np.sign(got[one, c + 1][0]["whitened"] * want[one])
        for i, w in want.items():
            assert got[i, c + 1][0]["whitened"] == pytest.approx(sign * w, abs=1e-9)


def test_few_directions_and_no_rows(spark):
    # All vectors lie on a line: one component; a single vector has none.
    line = [(k, [float(k), 2.0 * k, 0.0]) for k in range(50)]
    found = whitening.whiten(vectors(spark, line)).collect()
    assert {r["component"] for r in found} == {1} and len(found) == 50
    assert np.std([r["whitened"] for r in found]) == pytest.approx(1)
    assert found[0]["explained"] == pytest.approx(1)
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0])] * 3)).collect() == []
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, None), (2, [])])).collect() == []


def test_deviations_are_exact_or_null():
    x = np.array([[10**12, -5], [3, 4]])
    n, sums = 10**5, [7, 10**13]
    want = [sum((n * a - s) ** 2 for a, s in zip(map(int, v), sums)) for v in x]
    assert list(whitening._deviations(x, n, sums)) == [w if w < 2**63 else None for w in want]
    assert list(whitening._deviations(np.array([[3, 4]]), 2, [5, 6])) == [5]


# ---- spelling variants ----


def variants(rows, noise=None):
    """The contract, word by word."""
    lower = {c: c + 32 for c in range(65, 91)}
    counts = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if noise and h % noise == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    letters = sorted({c for w in words for c in w})

    def near(w):
        cuts = [(w[:k], w[k:]) for k in range(len(w) + 1)]
        made = {a + c + b for a, b in cuts for c in letters}
        made |= {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + b[1:] for a, b in cuts if b}
        return {x for x in made if x in words and x != w}

    form, n_near = {}, {}
    for w, n in words.items():
        found = near(w)
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w], n_near[w] = best if best and words[best] >= 5 * n else None, len(found)

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, n_near[w], words.get(form[w])) for w, n in words.items()}


def written_words(rng):
    stems = ["".join(rng.choice("abÉéz") for _ in range(rng.randint(5, 9))) for _ in range(25)]
    out = []
    for stem in stems:
        out += [stem] * rng.choice([40, 200, 1000])
        for _ in range(8):
            k, c = rng.randrange(len(stem)), rng.choice("abé")
            edited = rng.choice([stem[:k] + c + stem[k:], stem[:k] + stem[k + 1 :], stem[:k] + c + stem[k + 1 :]])
            out += [edited] * rng.choice([4, 5, 7, 30])
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("most_pairs", [spelling.MOST_PAIRS, 4])
def test_variants_agree_with_brute_force(spark, most_pairs):
    rng = random.Random(11)
    words = written_words(rng)
    rows = [(k, " ".join(words[k * 50 : k * 50 + 50])) for k in range(len(words) // 50)]
    rows += [(None, "Abbbbbb-aBBBBBB×ÀÀÀÀÀÀ " * 9), (1, None), (2, ""), (2, ""), (3, "x" * 3000), (4, "12 3")]
    rows += [(9, "prefixé1prefixe prefixee prefixe")] * 6
    docs = documents(spark, rows).repartition(5)
    for noise in (None, 19):
        found = spelling.group_variants(docs, noise=noise, most_pairs=most_pairs).collect()
        assert len(found) == len(set(found))
        want = variants(rows, noise)
        assert {tuple(r) for r in found} == want
    assert any(w[1] and w[2] != w[1] for w in want)
    assert spelling.group_variants(documents(spark, [(1, None)])).collect() == []


def test_a_common_stem_is_cut_until_groups_are_small(spark):
    # 2,000 words share their first eight letters and 2,000 their last eight.
    rng = random.Random(5)
    ends = list({"".join(rng.choice("abcd") for _ in range(8)) for _ in range(4000)})
    words = {"qqqqqqqq" + e for e in ends[:2000]} | {e + "qqqqqqqq" for e in ends[:2000]}
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n bigint")
    found = {frozenset((r["a"], r["b"])) for r in spelling.near_pairs(df, 64).collect()}
    want = set()
    for w in words:
        for k in range(16):
            for c in "abcdq":
                other = w[:k] + c + w[k + 1 :]
                if other != w and other in words:
                    want.add(frozenset((w, other)))
    assert found == want and len(want) > 500
