"""Substring repeats, Jaccard join, components, against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.llm import components, jaccard, substrings
from siltstone.llm.text import words

SCHEMA = "doc_id long, text string, lang string, node long"  # node: a clashing name


def made(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    docs = [say(rng.randint(0, 160)) for _ in range(40)]
    family = say(140)
    for _ in range(25):  # near copies of one text
        copy = list(family)
        for _ in range(rng.randint(1, 4)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        docs.append(copy)
    passage = say(60)
    for _ in range(12):  # one passage in different texts
        docs.append(say(rng.randint(5, 90)) + passage + say(rng.randint(5, 90)))
    chain = say(120)
    for i in range(8):  # a chain: each is like its neighbours only
        chain = chain[8:] + say(8)
        docs.append(list(chain))
    docs += [family, family, say(3), ["a", "b"], ["A", "b"], [], say(3000)]
    rows = [(i, " ".join(d), "en", 7) for i, d in enumerate(docs)]
    return [*rows, (len(rows), None, "en", None), (len(rows) + 1, "  \n\t ", None, 1)]


def shingles(text):
    w = words(text.encode()) if text else []
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def classes(ids, edges):
    parent = {i: i for i in ids}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    return {i: top(i) for i in ids}


def brute(rows):
    sets = {r[0]: shingles(r[1]) for r in rows}
    ids = list(sets)
    edges = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    comp = classes(ids, edges)
    return {(i, len(sets[i]), comp[i]) for i in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join_equals_brute_force(spark, seed):
    rows = made(seed)
    found = jaccard.join(spark.createDataFrame(rows, SCHEMA))
    assert {tuple(r) for r in found.collect()} == brute(rows)


def test_jaccard_long_columns_take_several_turns(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SHORT", 1)
    rows = made(3)
    assert {tuple(r) for r in jaccard.join(spark.createDataFrame(rows, SCHEMA)).collect()} == brute(rows)


def test_jaccard_empty_repeated_and_unnamed_rows(spark):
    assert jaccard.join(spark.createDataFrame([], SCHEMA)).collect() == []
    text = "one two three four five six"
    rows = [(3, text, "x", 1), (3, text, "x", 1), (None, text, "x", 1), (9, text.upper(), "x", 1), (5, "", "x", 1)]
    got = sorted(map(tuple, jaccard.join(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(3, 2, 3), (3, 2, 3), (None, 2, 3), (9, 2, 3), (5, 0, 5)], key=str)


def test_components_of_chain_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 200), (300, 301), (301, 300)]
    got = {tuple(r) for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(61)} | {(i, 100) for i in range(100, 140)} | {(300, 300), (301, 300)}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_compact_windows_cover_every_stretch_once():
    rng = np.random.default_rng(3)
    h = rng.integers(1, 12, 80).astype(np.uint64)  # with many ties
    h[[30, 31]] = 0
    width = 6
    windows = list(zip(*(x.tolist() for x in substrings.compact_windows(h, width)), strict=True))
    for i in range(len(h)):
        for j in range(i + width - 1, len(h)):
            over = [(lo, c, hi) for lo, c, hi in windows if lo <= i <= c <= j <= hi]
            if (h[i : j + 1] == 0).any():
                assert not over
            else:
                assert [c for _, c, _ in over] == [i + int(np.argmin(h[i : j + 1]))]


def test_repeats_finds_all_equal_passages_and_no_more(spark):
    rows = made(4)
    got = {r["doc_id"]: r for r in substrings.repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    seen, held = {}, {}
    for i, text, *_ in rows:
        held[i] = words(text.encode()) if text else []
        for k in range(len(held[i]) - 49):
            seen.setdefault(tuple(held[i][k : k + 50]), set()).add(i)
    assert set(got) == set(held)
    for i, w in held.items():
        want = {p for k in range(len(w) - 49) if len(seen[tuple(w[k : k + 50])]) > 1 for p in range(k, k + 50)}
        have = {p for s in got[i]["spans"] for p in range(s["start"], s["end"])}
        assert want <= have, i
        assert got[i]["n_words"] == len(w) and got[i]["n_repeated"] == len(have)
        # near passages: some passage with those words is similar to one elsewhere
        others = [shingle for j, o in held.items() if j != i for shingle in windows(o)]
        for s in got[i]["spans"]:
            own = windows(w[s["start"] : s["end"]])
            assert any(4 * len(a & b) >= 3 * len(a | b) for a in own for b in others)
    alone = [i for i in held if not got[i]["spans"] and list(held.values()).count(held[i]) == 1]
    assert len(alone) > 20 and all(got[i]["class_id"] == i for i in alone)


def test_passages_meet_around_a_line_that_many_texts_hold(spark):
    rng = random.Random(11)
    say = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    line = say(40)
    docs = [say(30) + line + say(30) for _ in range(60)]
    pairs = []
    for _ in range(30):
        tail = line + say(10)
        pairs.append((len(docs), len(docs) + 1))
        docs += [say(20) + tail + say(20), say(33) + tail + say(7)]
    got = {r["doc_id"]: r for r in substrings.repeats(spark.createDataFrame([(i, " ".join(d), "en", 7) for i, d in enumerate(docs)], SCHEMA)).collect()}
    missed = [(a, b) for a, b in pairs if got[a]["class_id"] != a or got[b]["class_id"] != a or got[a]["n_repeated"] < 50 or got[b]["n_repeated"] < 50]
    assert not missed
    assert all(got[i]["n_repeated"] == 0 for i in range(60))


@pytest.mark.parametrize(("families", "members"), [(40, 10), (1, 400)])
def test_near_passages_are_recalled(spark, families, members):
    """Texts whose passage of 50 words differs from their family's in one word: those
    with a passage like that of another text (40 of 46 shingles) should be found."""
    rng = random.Random(families)
    say = lambda n: [f"u{rng.randrange(100_000)}" for _ in range(n)]
    docs, like = [], []
    for _ in range(families):
        passage, lost = say(50), []
        for _ in range(members):
            at, own = rng.randrange(50), list(passage)
            own[at] = say(1)[0]
            docs.append(say(30) + own + say(30))
            lost.append(set(range(max(0, at - 4), min(45, at) + 1)))
        like += [any(i != j and 46 - len(a | b) >= 40 for j, b in enumerate(lost)) for i, a in enumerate(lost)]
    got = {r["doc_id"]: r["n_repeated"] > 0 for r in substrings.repeats(spark.createDataFrame([(i, " ".join(d), "en", 7) for i, d in enumerate(docs)], SCHEMA)).collect()}
    found = sum(got[i] for i, x in enumerate(like) if x)
    print("recall", found, sum(like), sum(got[i] for i, x in enumerate(like) if not x))
    assert found >= 0.9 * sum(like) and not any(got[i] for i, x in enumerate(like) if not x)


@pytest.mark.parametrize("kind", ["inserted", "deleted"])
@pytest.mark.parametrize(("families", "members"), [(40, 8), (1, 200)])
def test_passages_with_a_word_more_or_less_are_recalled(spark, kind, families, members):
    """Brute force over all pairs of windows within a family. In small families most
    have one partner, just above the threshold: one meeting by chance decides."""
    rng = random.Random(families)
    say = lambda n: [f"u{rng.randrange(100_000)}" for _ in range(n)]
    docs, like = [], []
    for _ in range(families):
        passage, own = say(50), []
        for _ in range(members):
            at = rng.randrange(50)
            own.append(say(30) + passage[:at] + (say(1) + passage[at:] if kind == "inserted" else passage[at + 1 :]) + say(30))
        held = [windows(w)[20:40] for w in own]
        like += [any(4 * len(x & y) >= 3 * len(x | y) for j, b in enumerate(held) if j != i for x in a for y in b) for i, a in enumerate(held)]
        docs += own
    got = {r["doc_id"]: r["n_repeated"] > 0 for r in substrings.repeats(spark.createDataFrame([(i, " ".join(d), "en", 7) for i, d in enumerate(docs)], SCHEMA)).collect()}
    found = sum(got[i] for i, x in enumerate(like) if x)
    print("recall", found, sum(like))
    assert found >= (0.9 if members > 8 else 0.85) * sum(like) and not any(got[i] for i, x in enumerate(like) if not x)


def test_overlaps_equal_sets(spark):
    rng = random.Random(9)
    for words_, n in ((10_000, 200), (30, 200), (2, 90)):
        a = np.array([rng.randrange(words_) for _ in range(n)], dtype=np.uint64)
        b = np.r_[a[5:60], a[70:], a[:20]]
        starts = np.array([0, 3, 20, 30], dtype=np.int64)
        for shift in (-4, 0):
            shared, either = substrings.overlaps(a, b, shift, starts)
            for s, o, e in zip(starts.tolist(), shared.tolist(), either.tolist(), strict=True):
                x, y = set(a[s : s + 46].tolist()), set(b[s - shift : s - shift + 46].tolist())
                assert (o, e) == (len(x & y), len(x | y))


def windows(w):
    return [frozenset(tuple(w[k + i : k + i + 5]) for i in range(46)) for k in range(len(w) - 49)]


def test_repeats_of_degenerate_text(spark):
    loop = "x y " * 300
    rows = [(1, loop, "", 0), (2, loop + "z", "", 0), (3, "short text", "", 0), (4, None, "", 0), (5, "short text", "", 0)]
    got = {r["doc_id"]: (r["n_repeated"], r["class_id"]) for r in substrings.repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1][1] == got[2][1] == 1 and got[1][0] == 600 and got[2][0] >= 600
    assert got[3] == (0, 3) and got[4] == (0, 4) and got[5] == (0, 3)
    assert substrings.repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_similar_passages_are_all_found_wherever_they_lie():
    """Moved, inserted, deleted and repeated words: against all pairs of windows, and by their keys."""
    rng = random.Random(5)
    say = lambda n, v: [b"w%d" % rng.randrange(v) for _ in range(n)]

    def changed(p):
        at = rng.randrange(len(p))
        return [p[:at] + say(1, 10**6) + p[at:], p[:at] + p[at + 1 :], p[at:] + p[:at], p[: at + 5] + p[at : at + 5] * 2 + p[at + 5 :], p][rng.randrange(5)]

    slots, none, like = np.zeros(substrings.SLOTS // 8, dtype=np.uint8), np.empty(0, dtype=np.uint64), 0
    for v in [10**5] * 40 + [30, 4, 2] * 8:
        p = say(rng.choice([50, 60, 90]), v)
        a, b = (say(20, v) + changed(p) + say(20, v) for _ in range(2))
        x, y = substrings.shingle_hashes(a), substrings.shingle_hashes(b)
        sets = [[set(h[i : i + 46].tolist()) for i in range(len(h) - 45)] for h in (x, y)]
        want = [(i, j) for i, s in enumerate(sets[0]) for j, t in enumerate(sets[1]) if 4 * len(s & t) >= 3 * len(s | t)]
        got = substrings.similar(substrings.Shingled(x), substrings.Shingled(y))
        assert [set(g.tolist()) for g in got] == [{i for i, _ in want}, {j for _, j in want}]
        loops = np.concatenate(substrings.looped([a, b]))
        slots[:] = 0
        np.bitwise_or.at(slots, substrings._slot(loops) >> 3, (1 << (substrings._slot(loops) & 7)).astype(np.uint8))
        key, doc, run = substrings.keys([a, b], none, slots)
        met = set(key[doc == 0].tolist()) & set(key[doc == 1].tolist())
        like += len(want) > 0
        assert not want or len(met) >= substrings.SHARED or (met and (run[np.isin(key, list(met))] & 1).any())
    assert like > 40


def test_every_near_passage_is_found(spark):
    """All links of a small family and, under keys of many texts, of a large one with strays."""
    rng = random.Random(8)
    say = lambda n: [f"u{rng.randrange(100_000)}" for _ in range(n)]
    docs, lines = [], []
    for members in [8] * 25 + [90]:
        passage, first = say(50), len(docs)
        for _ in range(members):
            at = rng.randrange(50)
            docs.append(say(30) + passage[:at] + say(1) + passage[at:] + say(30))
        held = [windows(w)[20:40] for w in docs[first:]]
        lines += [(first + i, first + j) for i, a in enumerate(held) for j, b in enumerate(held) if i < j and any(4 * len(x & y) >= 3 * len(x | y) for x in a for y in b)]
    got = {r["doc_id"]: r for r in substrings.repeats(spark.createDataFrame([(i, " ".join(d), "en", 7) for i, d in enumerate(docs)], SCHEMA)).collect()}
    least = list(range(len(docs)))
    for _ in docs:
        for a, b in lines:
            least[a] = least[b] = min(least[a], least[b])
    linked = {i for pair in lines for i in pair}
    assert {i for i, r in got.items() if r["n_repeated"]} == linked
    assert [got[i]["class_id"] for i in range(len(docs))] == least


def test_many_pairs_at_once_are_compared_as_one_by_one(monkeypatch):
    """Pairs that share a second text, with changed, looped and far repeated passages; few are left to be compared alone."""
    rng = random.Random(6)
    say = lambda n, v=10**6: [b"w%d" % rng.randrange(v) for _ in range(n)]
    rows = []
    for b in range(25):
        p, v = say(rng.choice([50, 70, 120])), 4 if b % 5 == 4 else 10**6
        two = say(20) + p + (say(60) + p if b % 5 == 3 else say(20, v))
        for a in range(b + 1, b + 7):
            at = rng.randrange(len(p))
            made = [p, p[:at] + say(1) + p[at:], p[:at] + p[at + 1 :], p[at:] + p[:at], say(60), say(3) + p[:at] + say(2) + p[at + 2 :]][rng.randrange(6)]
            one = say(rng.randrange(30)) + made + say(20, v)
            rows.append((a, b, rng.randrange(9), b % 3, *(substrings.shingle_hashes(x).astype("<u8").tobytes() for x in (one, two))))
    cols = [pa.array(c) for c in zip(*rows, strict=True)]
    batch = pa.RecordBatch.from_arrays(cols, names=["a", "b", "low_a", "low_b", "ha", "hb"])
    want = []
    for a, b, low_a, low_b, one, two in rows:
        own, other = substrings.similar(*(substrings.Shingled(np.frombuffer(x, dtype="<u8")) for x in (one, two)))
        if len(own):
            want += [(a, b, a, *s) for s in substrings._spans(own + low_a)] + [(a, b, b, *s) for s in substrings._spans(other + low_b)]
    calls, similar = [], substrings.similar
    monkeypatch.setattr(substrings, "similar", lambda x, y: calls.append(1) or similar(x, y))
    for places, some in ((1 << 18, batch), (500, batch), (2000, batch.slice(7, 90))):
        monkeypatch.setattr(substrings, "PLACES", places)
        got = [tuple(map(int, r)) for cols in substrings.spans_of(some) for r in zip(*cols, strict=True)]
        keep = {r[:2] for r in rows[7:97]} if some is not batch else {r[:2] for r in rows}
        assert sorted(got) == sorted(tuple(map(int, r)) for r in want if r[:2] in keep)
    assert len(want) > 100 and len(calls) < len(rows)


def test_least_ranks_equal_sorted_stretches():
    rng = np.random.default_rng(0)
    for width in (2, 3, 7, 46):
        o = rng.integers(0, 60, 9000).astype(np.uint32)
        rows = np.sort(np.lib.stride_tricks.sliding_window_view(o, width), axis=1)
        nths = (1, 2) if width < 12 else (8, 12)
        assert (substrings.least_ranks(o, nths, width) == rows[:, [n - 1 for n in nths]]).all()


def test_large_families_and_common_lines_are_not_compared_each_with_each(spark, monkeypatch):
    """Texts with own words around one line that others hold in loops, and near copies of one text."""
    rng = random.Random(3)
    say = lambda n: [f"u{rng.randrange(100_000)}" for _ in range(n)]
    line, text, docs = say(60), say(150), []
    for i in range(150):
        docs.append(say(30) + line + (say(30) if i % 10 else ["a", "b", "c"] * 12))
        docs.append([w if rng.random() > 0.02 else say(1)[0] for w in text])
    seen, verified = [], substrings.verified
    monkeypatch.setattr(substrings, "verified", lambda pairs, held: seen.append(pairs.count()) or verified(pairs, held))
    got = {r["doc_id"]: r for r in substrings.repeats(spark.createDataFrame([(i, " ".join(d), "en", 7) for i, d in enumerate(docs)], SCHEMA)).collect()}
    print("pairs", seen)
    assert all(got[i]["n_repeated"] >= 60 and got[i]["class_id"] == 0 for i in range(0, 300, 2))
    assert sum(seen) < 30 * len(docs)


def test_words_are_hashed_as_they_are_split():
    rows = ["Ab c\tD", "", None, " x ", "longword" * 30_000 + " a", "\u00e9\x0b\u00c9 \u00e9", "ab C", "a\x1cb", "d"]
    for column in (pa.array(rows), pa.array(rows).slice(2, 5)):
        want = [words(x.encode()) if x else [] for x in column.to_pylist()]
        each, sizes = (np.concatenate(x) for x in zip(*substrings._in_chunks(column), strict=True))
        assert sizes.tolist() == [len(x) for x in want]
        flat = [w for x in want for w in x]
        assert len(set(zip(flat, each.tolist(), strict=True))) == len(set(flat)) == len(set(each.tolist()))


def test_only_what_comparisons_read_of_a_text_is_stored(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**9)}"
    shared = [word() for _ in range(60)]
    docs = [[word() for _ in range(3000)] + shared + [word() for _ in range(i)] for i in (2000, 1500)]
    sizes, store = [], substrings.store

    def told(df, name):
        out = store(df, name)
        if name == "held":
            sizes.append(out.agg(F.sum(F.octet_length("h"))).collect()[0][0])
        return out

    monkeypatch.setattr(substrings, "store", told)
    got = substrings.repeats(spark.createDataFrame([(i, " ".join(d), "en", 7) for i, d in enumerate(docs)], SCHEMA)).collect()
    assert all(s["start"] <= 3000 and s["end"] >= 3060 for r in got for s in r["spans"]) and all(r["n_repeated"] >= 60 and r["class_id"] == 0 for r in got)
    assert len(sizes) == 1 and sizes[0] <= 2 * 8 * 300  # of texts of 5060 and 4560 words


def test_comparisons_in_turns_find_the_same(spark, monkeypatch):
    rows = made()
    told = lambda: sorted(map(str, substrings.repeats(spark.createDataFrame(rows, SCHEMA)).collect()))
    want, turns, store = told(), [], substrings.store
    monkeypatch.setattr(substrings, "TURN", 1)
    monkeypatch.setattr(substrings, "store", lambda df, name: turns.append(name) or store(df, name))
    assert told() == want and turns.count("verified") > 1
