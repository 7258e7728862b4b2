"""Substring dedup, decontamination, Jaccard join and license scan against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from partlog.llm import decontamination, jaccard, licenses, substrings
from partlog.llm.words import Words, runs

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, grp string, row int"
VOCABULARY = [f"w{k}" for k in range(400)]


def documents(spark, rows):
    """A table with columns whose names operators use inside."""
    full = [(i, t, "en", "s", len(t or ""), "x", 7) for i, t in rows]
    return spark.createDataFrame(full, DOCS)


def corpus(seed: int):
    """Random texts with copies, near copies, shared passages, repeated words, odd rows."""
    rng = random.Random(seed)
    words = lambda n: [rng.choice(VOCABULARY) for _ in range(n)]
    passage = words(60)
    rows = [(0, None), (1, ""), (2, " \t\n "), (3, "one two"), (4, "ONE\ttwo "), (5, "x " * 300)]
    for i in range(6, 40):
        rows.append((i, " ".join(words(rng.randint(1, 200)))))
    for i in range(40, 60):
        rows.append((i, rng.choice(rows[6:40])[1]))
    for i in range(60, 90):
        w = rng.choice(rows[6:40])[1].split(" ")
        for _ in range(max(1, len(w) // 60)):
            w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
        rows.append((i, "\n".join(w)))
    for i in range(90, 110):
        rows.append((i, " ".join(words(rng.randint(0, 30)) + passage + words(rng.randint(0, 30)))))
    rows.append((110, " ".join(words(20_000))))
    rows.append((111, rows[-1][1] + " more"))
    rng.shuffle(rows)
    return rows


def brute_repeats(rows, window=20):
    seen, want = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            key = tuple(w[a : a + window])
            if key in seen:
                gone[a : a + window] = [True] * window
            seen.add(key)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        want[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return want


@pytest.mark.parametrize("bucket_bytes", [4 << 20, 2000])
def test_substrings_match_brute_force(spark, monkeypatch, bucket_bytes):
    monkeypatch.setattr(substrings, "BUCKET_BYTES", bucket_bytes)
    monkeypatch.setattr(substrings, "HOT", 3)
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 5000)
    rows = corpus(1)
    found = substrings.remove_repeats(documents(spark, rows).repartition(5)).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found}
    assert got == brute_repeats(rows)
    assert all(hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"] for r in found)


def test_substrings_odd_rows(spark):
    text = " ".join(VOCABULARY[:30])
    # A null id comes first; repeated rows count as one document.
    df = documents(spark, [(None, text), (7, text), (9, "other"), (9, "other"), (8, None)])
    found = {(r["doc_id"], r["n_removed"]) for r in substrings.remove_repeats(df).collect()}
    assert found == {(None, 0), (7, 30), (9, 0), (8, 0)}
    twice = documents(spark, [(3, text), (3, text)])
    assert [r["n_removed"] for r in substrings.remove_repeats(twice).collect()] == [0, 0]
    assert substrings.remove_repeats(df.where("false")).collect() == []


def test_merged_ranges_are_exact_for_many_documents():
    n = 200_000
    doc = np.repeat(np.arange(n), 4)
    low, high = np.tile([10, 30, 44, 60], n), np.tile([33, 45, 51, 61], n)
    ranges = np.stack([doc, np.zeros_like(doc), low, high])
    found = substrings._merged(ranges[:, np.random.default_rng(3).permutation(4 * n)])
    assert found["doc"].tolist() == np.repeat(np.arange(n), 2).tolist()
    assert found["low"].tolist() == [10, 60] * n
    assert found["high"].tolist() == [51, 61] * n


def test_exact_words_do_not_trust_hashes(monkeypatch):
    monkeypatch.setattr(Words, "hashes", lambda self: (self.end - self.start).astype(np.uint64))
    ids = substrings._exact_words(Words([b"ab cd ab e", b"cd x"]))
    assert ids[0] == ids[2] != ids[1] == ids[4] and ids[3] != ids[5]


def test_words_and_runs():
    words = Words([b"", "é  b\x0bc".encode(), b"b" * 100 + b" b"])
    assert [words.buffer[a:b].decode() for a, b in zip(words.start, words.end)] == [
        "é",
        "b",
        "c",
        "b" * 100,
        "b",
    ]
    assert words.first.tolist() == [0, 0, 3, 5]
    h = words.hashes()
    assert h[1] == h[4] and len(set(h.tolist())) == 4
    assert len(runs(h, 3)) == 3 and len(runs(h, 9)) == 0


def shingles(text):
    fold = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    w = (text or "").encode().translate(fold).split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute_groups(rows):
    sets = {i: shingles(t) for i, t in rows}
    name = {i: i for i in sets}

    def root(x):
        while name[x] != x:
            x = name[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = root(a), root(b)
                name[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in ids}


def groups(df):
    found = jaccard.group_documents(df).collect()
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found}


@pytest.mark.parametrize("hot", [64, 2])
def test_jaccard_matches_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "BUCKET_BYTES", 50_000)
    rows = corpus(2)
    assert groups(documents(spark, rows).repartition(4)) == brute_groups(rows)


def test_jaccard_does_not_pair_texts_for_a_common_passage(spark):
    """Sets choose what is rare first: a passage in some texts makes no groups, near copies do."""
    rng = random.Random(8)
    own = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    passage = own(120)
    rows = [(k, f"{own(150)} {passage} {own(30)}") for k in range(50)]
    rows += [(100 + k, f"{rows[k][1]} {own(9)}") for k in range(5)]
    df = documents(spark, rows)
    members = jaccard.candidate_groups(df.select("text"), sum(len(t) for _, t in rows))
    assert {r["n"] for r in members.groupBy("grp").agg(F.count_distinct("class").alias("n")).collect()} == {2}
    assert members.select("class").distinct().count() == 10
    assert groups(df) == brute_groups(rows)


def test_jaccard_pairs_grow_with_a_group_of_near_copies(spark, monkeypatch):
    """Copies that link with their source but not with each other are not tried in all pairs."""
    rng, made = random.Random(12), []
    write = jaccard.written

    def counted(df, name):
        out = write(df, name)
        if name == "jaccard-pairs":
            made.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "HOT", 2)
    monkeypatch.setattr(jaccard, "written", counted)
    source = [f"w{rng.randrange(10**9)}" for _ in range(100)]

    def copy(edits):
        words = list(source)
        for at in rng.sample(range(5, 95), edits):
            words[at] = f"w{rng.randrange(10**9)}"
        return " ".join(words)

    rows = [(0, " ".join(source))]
    rows += [(k, copy(2)) for k in range(1, 100)] + [(k, copy(4)) for k in range(100, 150)]
    assert groups(documents(spark, rows).repartition(4)) == brute_groups(rows)
    assert sum(made) <= 4 * len(rows)


def test_jaccard_sends_a_quarter_of_the_shingles_of_common_sets(spark, monkeypatch):
    """Copies whose segments are all common send their rarest shingles, not their whole sets."""
    rng, sent = random.Random(21), []
    write = jaccard.written

    def counted(df, name):
        out = write(df, name)
        if name in ("jaccard-shingles", "jaccard-ranked"):
            sent.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "HOT", 2)
    monkeypatch.setattr(jaccard, "written", counted)
    own = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for first in (0, 100):
        source = own(120)
        for k in range(40):
            words = list(source)
            words[rng.randrange(5, 115)] = own(1)[0]
            rows.append((first + k, " ".join(words)))
    want = brute_groups(rows)
    assert groups(documents(spark, rows).repartition(4)) == want
    assert len(sent) == 1 and 0 < sent[0] <= sum(n // 4 + 1 for n, _ in want.values())


def test_jaccard_components_are_joined_by_later_links(spark):
    names = spark.createDataFrame([(3, 3), (4, 3), (7, 7), (8, 7)], "node bigint, component bigint")
    found = lambda links: {tuple(r) for r in jaccard._joined(names, links).collect()}
    links = spark.createDataFrame([(4, 8), (9, 11), (1, 8), (3, 4)], "a bigint, b bigint")
    assert found(links) == {(1, 1), (3, 1), (4, 1), (7, 1), (8, 1), (9, 9), (11, 9)}
    assert found(links.limit(0)) == {(3, 3), (4, 3), (7, 7), (8, 7)}


@pytest.mark.parametrize("slots", [15, 27])
def test_jaccard_links_hold_when_the_bit_sets_are_full(spark, monkeypatch, slots):
    monkeypatch.setattr(jaccard, "MOST_SLOTS", slots)
    monkeypatch.setattr(jaccard, "RARE", 2)
    rows = corpus(3)
    assert groups(documents(spark, rows).repartition(4)) == brute_groups(rows)


def test_jaccard_small_sets_and_chains(spark):
    rng = random.Random(5)
    rows, base = [], [rng.choice(VOCABULARY) for _ in range(80)]
    for n in range(1, 14):  # sets of 1 to 9 shingles that differ by one at their end
        rows.append((n, " ".join(VOCABULARY[:n])))
    for k in range(40):  # a chain: neighbours link, the ends do not
        rows.append((100 + k, " ".join(base[k : k + 40])))
    assert groups(documents(spark, rows)) == brute_groups(rows)


def test_jaccard_threshold_holds_exactly(spark):
    # 4 of 5 and 3 of 4 shingles shared: 0.8 and 0.75 link; 5 of 7 does not.
    w = VOCABULARY
    rows = [(1, " ".join(w[:8])), (2, " ".join(w[:7])), (3, " ".join(w[20:31])), (4, " ".join(w[20:29]))]
    assert groups(documents(spark, rows)) == {1: (4, 1), 2: (3, 1), 3: (7, 3), 4: (5, 4)}


def test_jaccard_odd_rows_and_dedup(spark):
    text = " ".join(VOCABULARY[:50])
    rows = [(None, None), (1, ""), (2, " \n"), (5, text), (4, text.upper()), (9, "a b"), (9, "a b")]
    df = documents(spark, rows)
    assert groups(df) == {
        None: (0, None),
        1: (0, 1),
        2: (0, 2),
        5: (46, 4),
        4: (46, 4),
        9: (1, 9),
    }
    kept = jaccard.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "4", "9", "None"]
    assert groups(df.where("false")) == {}


def test_dedup_tells_texts_of_one_id_apart(spark):
    text = lambda k: " ".join(VOCABULARY[40 * k : 40 * k + 40])
    rows = [
        (10, text(0)), (10, text(1)), (10, text(0)),  # two texts of one id, one row repeated
        (3, text(2)), (11, text(2)), (11, text(3)),  # a copy of a smaller id, and another text
        (None, text(4)), (None, text(4) + " more"), (None, text(5)),  # near copies without an id
        (None, text(3) + " more"), (None, text(6)), (None, text(6)),
        (12, text(7)), (12, text(7) + " more"),  # near copies of one id
        (9, text(8)), (100, text(8)), (13, None), (13, ""), (None, " "), (None, " "),
    ]
    df = documents(spark, rows).repartition(3)
    df = df.withColumnsRenamed({"grp": "doc", "row": "text_key", "lang": "copies"})
    found = jaccard.deduplicate(df)
    assert found.columns == df.columns
    kept = sorted((str(r["doc_id"]), (r["text"] or "").removesuffix(" more")) for r in found.collect())
    want = [(10, 0), (10, 1), (3, 2), (11, 3), (None, 4), (None, 5), (None, 6), (12, 7), (9, 8)]
    blank = [("13", ""), ("13", ""), ("None", " "), ("None", " ")]
    assert kept == sorted([(str(i), text(k)) for i, k in want] + blank)


def test_tiles_find_moved_passages(spark):
    w = VOCABULARY
    item = " ".join(w[:40])
    moved = " ".join(w[100:110] + w[20:40] + w[110:120] + w[:20])
    half = " ".join(w[:19] + w[200:240])
    docs = documents(
        spark, [(1, moved), (2, half), (3, item.upper() + "!"), (4, None), (5, ""), (3, item)]
    )
    items = spark.createDataFrame(
        [(1, item), (2, "too short"), (3, None), (None, "")], "item_id bigint, text string"
    )
    found = {(r["doc_id"], r["covered"], r["n_tiles"]) for r in decontamination.tiles(docs, items).collect()}
    assert found == {(1, 40, 2), (2, 19, 1), (3, 40, 1)}
    judged = decontamination.judged(docs, items).select("doc_id", "contaminated", "item_id").collect()
    assert sorted((r[0], r[1], r[2]) for r in judged) == [
        (1, True, 1),
        (2, False, None),
        (3, True, 1),
        (3, True, 1),
        (4, False, None),
        (5, False, None),
    ]
    left = decontamination.decontaminate(docs, items)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [2, 4, 5]
    none = decontamination.judged(docs, items.where("false")).where("contaminated").count()
    assert none == 0 and decontamination.judged(docs.where("false"), items).count() == 0


def test_tiles_do_not_depend_on_blocks(spark):
    rng = random.Random(3)
    items = [[rng.choice(VOCABULARY[:60]) for _ in range(rng.randint(5, 40))] for _ in range(30)]
    docs = []
    for i in range(30):
        parts = [rng.choice(items) for _ in range(2)]
        text = [rng.choice(VOCABULARY) for _ in range(20)]
        for p in parts:
            k = rng.randrange(len(p))
            text += p[k:] + p[:k]
        docs.append((i, " ".join(text)))
    table = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id bigint, text string")
    key = lambda r: (r["doc_id"], r["item_id"], r["covered"], r["n_tiles"])
    one = sorted(map(key, decontamination.tiles(documents(spark, docs), table).collect()))
    many = decontamination.tiles(documents(spark, docs), table, block_words=100)
    assert sorted(map(key, many.collect())) == one and len(one) >= 40


def test_greedy_tiling_takes_the_longest_first():
    item, doc = list("abcdefghij"), list("abcdeXabcdefghYhij")
    pairs = [
        (i, j) for i in range(9) for j in range(17) if item[i : i + 2] == doc[j : j + 2]
    ]
    assert decontamination.tile(item, doc, pairs, 2) == [(0, 6, 8), (8, 16, 2)]


def test_licenses_match_brute_force(spark):
    rng = random.Random(4)
    rows = [(1, None), (2, ""), (3, "Licensed under the Apache License, Version 2.0.")]
    for i in range(4, 60):
        name, text = rng.choice(sorted(licenses.TEMPLATES.items()))
        words = text.split()
        if rng.random() < 0.5:
            words[rng.randrange(len(words))] = "other"
        around = [rng.choice(VOCABULARY) for _ in range(rng.randint(0, 60))]
        k = rng.randrange(len(around) + 1)
        rows.append((i, " ".join(around[:k] + words + around[k:]).upper()))
    rows.append((3, rows[2][1]))

    def three(text):
        w = re.findall(r"[^\W_]+", (text or "").lower())
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}

    want = []
    for i, text in rows:
        for name, template in licenses.TEMPLATES.items():
            share = len(three(template) & three(text)) / len(three(template))
            if share >= licenses.THRESHOLD:
                want.append((i, name, share))
    found = licenses.scan(documents(spark, rows))
    assert sorted((r[0], r[1], r[2]) for r in found.collect()) == sorted(want) and len(want) > 20
    assert licenses.scan(documents(spark, rows).where("false")).collect() == []
    with pytest.raises(ValueError):
        licenses.scan(documents(spark, rows), {"a": "two words"})


def test_short_and_common_notices_are_found(spark):
    rng = random.Random(8)
    some = lambda n: " ".join(rng.choice(VOCABULARY) for _ in range(n))
    # By bands alone, about one in 200 of these would be missed.
    rows = [(i, f"{some(rng.randint(12, 30))}. All rights reserved. {some(20)}") for i in range(3000)]
    rows += [(10_000 + i, "all rights are reserved") for i in range(5)]
    found = licenses.scan(documents(spark, rows), {"short": "All rights reserved.", "four": "a b c d"})
    assert {(r["doc_id"], r["template"], r["containment"]) for r in found.collect()} == {
        (i, "short", 1.0) for i in range(3000)
    }
    gpl = (
        "This program is free software: you can redistribute it and/or modify it under the terms"
        " of the GNU General Public License as published by the Free Software Foundation, either"
        " version 3 of the License, or (at your option) any later version."
    )
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a"
    mpl += " copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org"
    rows = [(1, f"{some(9)} {gpl} {some(9)}"), (2, mpl), (3, "(c) X. ALL RIGHTS RESERVED!")]
    rows += [(4, gpl.replace("General", "Lesser General")), (5, some(50))]
    found = licenses.scan(documents(spark, rows)).where("containment > 0.95").collect()
    names = {(r["doc_id"], r["template"]) for r in found}
    assert {(1, "GPL-header"), (2, "MPL-2.0"), (3, "all-rights-reserved")} <= names
    assert max(licenses.missed(n) for n in range(licenses.EXACT + 1, 15)) <= 1e-7
    assert licenses.EXACT == 2  # pieces of three and four words


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(9)
    for n, m, common in [(500, 480, 300), (40, 1000, 20), (6, 7, 6), (3000, 2600, 2500), (5, 5, 0)]:
        hashes = np.unique(rng.integers(0, 2**63, n + m, dtype=np.uint64))
        x, y = np.sort(hashes[:n]), np.sort(hashes[n - common : n - common + m])
        differ = len(np.setxor1d(x, y))
        bound = jaccard.least_difference(jaccard.bitmap(x), jaccard.bitmap(y))
        assert bound <= differ and (n > 2 * m or m > 2 * n or bound >= differ / 3)
        linked = 100 * len(np.intersect1d(x, y)) >= 75 * len(np.union1d(x, y))
        assert linked == (differ <= jaccard.most_difference(len(x), len(y)))
