"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeated rows, extra columns; and on empty ones."""

import bisect
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparklode.llm import fingerprints, language, line_dedup, media, mixing, ngram_join, packing, quality, substring_dedup, toxicity
from sparklode.llm.suffix_array import common_prefixes, suffix_array

DOCS = "doc_id long, text string, lang string, source string, range string, tokens string, place int"
R = random.Random(3)
VOCABULARY = ["".join(R.choices("abcdefghij", k=R.randint(1, 7))) for _ in range(400)]
SYLLABLES = {"en": "the of and ing ion er", "de": "sch ung ich keit der und", "fr": "eau eux ai ou le que"}


def prose(r, n, words=VOCABULARY):
    return " ".join(r.choice(words) + ("\n" if r.random() < 0.06 else "") for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    texts = [prose(r, r.randint(1, 160)) for _ in range(60)]
    for i in range(25):  # near copies, copies, shared passages
        words = texts[i].split(" ")
        for _ in range(r.randint(0, 3)):
            words[r.randrange(len(words))] = r.choice(VOCABULARY)
        texts.append(" ".join(words))
    passage = prose(r, 40)
    texts += [prose(r, 20) + " " + passage + " " + prose(r, 20) for _ in range(12)]
    texts += [texts[3]] * 12 + ["", None, "x", "a b c", "A  b\tC", "a b c d e", "é ü ß", " \n\t ", "aaaa " * 400, "z" * 3000, prose(r, 6000), "123 456"]
    out = [(i, t, "en", "s", "clash", "clash", 1) for i, t in enumerate(texts)]
    r.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def lowered_words(text):
    b = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    return re.findall(rb"[^\x20\x09-\x0D]+", b)


def shingles(text):
    w = lowered_words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def alike(a, b):
    return bool(a and b) and 100 * len(a & b) >= 75 * len(a | b)


def brute_components(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and alike(sets[a], sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_ngram_join(docs, rows, empty):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == brute_components({i: t for i, t, *_ in rows})
    assert ngram_join.near_duplicates(empty).count() == 0


def test_ngram_join_of_large_groups_and_null_ids(spark):
    r = random.Random(1)
    base = [r.choice(VOCABULARY) for _ in range(120)]
    passage = [r.choice(VOCABULARY) for _ in range(60)]
    rows = []
    for i in range(60):  # more than FEW near copies, and more than FEW that share a passage only
        words = list(base)
        for _ in range(r.randint(1, 4)):
            words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join([*passage, *(f"u{i}x{k}" for k in range(r.randint(2, 40)))])) for i in range(40)]
    rows += [(None, "a b c d e f"), (7, rows[7][1])]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == brute_components({i: t for i, t in rows if i is not None})
    assert [(r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is None] == [(None, None)]


def test_one_of_each(spark, docs, rows):
    want = {i for i, (_, c) in brute_components({i: t for i, t, *_ in rows}).items() if i == c}
    got = ngram_join.one_of_each(docs)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == sorted(want)
    texts = [prose(random.Random(k), 40) for k in range(3)]
    given = spark.createDataFrame([(5, texts[0], 1), (5, texts[1], 2), (5, texts[1], 2), (6, texts[1], 3), (4, texts[2], 4), (None, texts[2], 5), (5, None, 6), (None, None, 7)], "doc_id long, text string, Doc int")
    for n in (1, 3):
        assert sorted((r["Doc"] for r in ngram_join.one_of_each(given.repartition(n)).collect())) == [1, 2, 4, 5, 6, 7]
    found = sorted((r["doc_id"] or 0, r["n_shingles"] or 0, r["component_id"] or 0) for r in ngram_join.near_duplicates(given).collect())
    n = [len(shingles(t)) for t in texts]
    assert found == sorted([(5, n[0], 5), (5, n[1], 5), (5, n[1], 5), (6, n[1], 5), (4, n[2], 4), (0, 0, 0), (5, 0, 5), (0, 0, 0)])


def test_ngram_join_of_sets_whose_segments_are_too_few(spark):
    """Sets that can't be allocated enough segments meet their partners by their shingles."""
    from sparklode.llm._words import shingle_sets

    r = random.Random(17)
    texts = [" ".join(f"w{r.randrange(10**9)}" for _ in range(11)) for _ in range(40_000)]
    slack = ngram_join.signatures(shingle_sets([t.encode() for t in texts]))[2]
    lone = [texts[k] for k in np.flatnonzero(slack < 0)]
    assert lone
    rows = list(enumerate([*lone, *(f"{t} more" for t in lone), *(t.split(" ", 1)[1] for t in lone), *texts[:200]]))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(dict(rows))


def brute_lines(rows):
    """Text and number of removed lines of each (doc_id, text), in that order."""
    earlier, out = [], []
    for _, t in rows:
        kept, gone = [], 0
        for line in (t or "").split("\n"):
            own = shingles(line)
            if any(alike(own, e) for e in earlier):
                gone += 1
            else:
                kept.append(line)
            earlier.append(own) if own else None
        out.append((None if t is None else "\n".join(kept), gone))
    return out


def test_line_dedup(spark, docs, rows, empty):
    more = [(9000 + i, f"Read more\nown line number {i} of page nine thousand\n\n \nshare  this\tPAGE", *rows[0][2:]) for i in range(30)] + [(9100, "read MORE\nread more now\nmore read\nread", *rows[0][2:])]
    ordered = sorted((i, t) for i, t, *_ in rows + more)
    want = dict(zip([i for i, _ in ordered], brute_lines(ordered)))
    assert sum(gone for i, (_, gone) in want.items() if i >= 9000) >= 59
    got = line_dedup.dedup(docs.unionByName(spark.createDataFrame(more, DOCS)))
    assert {"range", "tokens", "place"} <= set(got.columns)
    assert {r["doc_id"]: (r["text"], r["n_removed"]) for r in got.collect()} == want
    assert line_dedup.dedup(empty).count() == 0 and line_dedup.cleaned(empty).count() == 0


def test_line_dedup_of_a_passage_with_many_edits(spark, monkeypatch):
    """Lines of one passage, each with words of its own: those that no parity rules out are all that goes to verification, and the result is exact."""
    r = random.Random(41)
    passage = [r.choice(VOCABULARY) + str(i) for i in range(64)]
    texts = []
    for i in range(240):
        words = list(passage)
        for k in r.sample(range(4, 60), r.choice((1, 2, 2, 2))):
            words[k] = f"own{i}x{k}"
        texts.append((i, " ".join(words)))
    tried = []
    verify = line_dedup.verify
    monkeypatch.setattr(line_dedup, "verify", lambda docs, pairs, parts: (tried.append(pairs.count()), verify(docs, pairs, parts))[1])
    got = line_dedup.dedup(spark.createDataFrame(texts, "doc_id long, text string").repartition(4))
    sets = [shingles(t) for _, t in texts]
    alike = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    assert {x["doc_id"]: x["n_removed"] for x in got.collect()} == {i: int(any(alike(sets[i], sets[j]) for j in range(i))) for i in range(len(sets))}
    assert sum(tried) < 3 * sum(alike(sets[i], sets[j]) for i in range(240) for j in range(i))


def removed_by_brute_force(texts):
    """Of lines by id: whether an earlier one is alike."""
    sets = {i: shingles(t) for i, t in texts}
    return {i: int(any(100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) for j in sets if j < i)) for i in sets}


def edited_passage(r, lines):
    """(id, passage with one word of its own): lines match where their words are at most three places apart, a ninth of all pairs; and copies of some."""
    passage = [r.choice(VOCABULARY) + str(i) for i in range(64)]
    texts = []
    for i in range(lines):
        words, at = list(passage), r.randrange(2, 62)
        words[at] = f"own{i}"
        texts.append((i, " ".join(words)))
    return texts + [(lines + i, t) for i, t in texts[:: 3] * 3]


def test_line_dedup_of_many_lines_that_match_many(spark, monkeypatch):
    """What goes to verification grows with the lines of a group of near copies, not with its pairs that match."""
    texts = [(k, t) for k, (_, t) in enumerate(edited_passage(random.Random(43), 300))]
    tried = []
    verify = line_dedup.verify
    monkeypatch.setattr(line_dedup, "verify", lambda docs, pairs, parts: (tried.append(pairs.count()), verify(docs, pairs, parts))[1])
    got = line_dedup.dedup(spark.createDataFrame(texts, "doc_id long, text string").repartition(4))
    assert {x["doc_id"]: x["n_removed"] for x in got.collect()} == removed_by_brute_force(texts)
    assert 0 < sum(tried) <= 3 * 300


@pytest.mark.parametrize("looked_up", [0, 10**6])
def test_line_dedup_of_lines_that_the_nearest_leave_open(spark, monkeypatch, looked_up):
    """With one earlier line of three to try at first, the others are still tried: the result is the same."""
    texts = [(k, t) for k, (_, t) in enumerate(edited_passage(random.Random(47), 120))]
    tried = []
    verify = line_dedup.verify
    monkeypatch.setattr(line_dedup, "verify", lambda docs, pairs, parts: (tried.append(pairs.count()), verify(docs, pairs, parts))[1])
    for name, value in (("NEAREST", 1), ("WINDOW", 3), ("LOOKED_UP", looked_up)):
        monkeypatch.setattr(line_dedup, name, value)
    got = line_dedup.dedup(spark.createDataFrame(texts, "doc_id long, text string").repartition(4))
    assert {x["doc_id"]: x["n_removed"] for x in got.collect()} == removed_by_brute_force(texts)
    assert len(tried) == 2 and tried[1] > 0


@pytest.mark.parametrize("keep, window", [(1, 3), (2, 5), (2, 1000)])
def test_nearest_postings(keep, window):
    r = np.random.default_rng(5)
    first, length = np.array([2, 20, 60]), np.array([9, 40, 30])
    n, at, bits = r.integers(20, 30, 90), r.integers(0, 4, 90), r.integers(0, 12, 90)
    parity = np.zeros((12, 4), np.uint64)
    parity[:, :2] = r.integers(0, 8, (12, 2))
    x, y, left = line_dedup.nearest(first, length, n, at, parity, bits, keep, window)
    want, open_ones = set(), set()
    for a, k in zip(first.tolist(), length.tolist()):
        for j in range(a, a + k):
            found = []
            for i in range(max(a, j - window), j):
                least = -(-3 * (n[i] + n[j]) // 7)
                differ = sum(int(p ^ q).bit_count() for p, q in zip(parity[bits[i]].tolist(), parity[bits[j]].tolist()))
                if 4 * min(n[i], n[j]) >= 3 * max(n[i], n[j]) and min(n[i] - at[i], n[j] - at[j]) >= least and 7 * differ <= n[i] + n[j]:
                    found.append((differ, i))
            found.sort()
            taken = found[: 1 if found and found[0][0] == 0 else keep]
            want |= {(i, j) for _, i in taken}
            if len(taken) < len(found) or j - a > window:
                open_ones.add(j)
    assert len(x) == len(want) and set(zip(x.tolist(), y.tolist())) == want
    assert left.tolist() == sorted(open_ones)


def test_line_dedup_verifies_wanted_lines_only(monkeypatch):
    """Tokens are worked out once for the wanted lines of many documents, not for each document's whole text; the same as from whole texts."""
    from sparklode.llm import line_dedup

    r = random.Random(4)
    texts = [None, "", "\n\n", *("\n".join(" ".join(r.choice("abcdé") for _ in range(r.randrange(12))) for _ in range(r.randrange(1, 9))) for _ in range(60))]
    wanted = [[{"line": r.randrange(10), "hub_doc": r.randrange(9), "hub_line": 1, "salt": 2} for _ in range(3)] for _ in texts]
    want = []
    for doc, (text, some) in enumerate(zip(texts, wanted, strict=True)):
        _, number, line, token = line_dedup.line_tokens([(text or "").encode()])
        sets = {n: token[line == i].tobytes() for i, n in enumerate(number.tolist())}
        want += [(w["hub_doc"], 1, 2, doc, w["line"], sets[w["line"]]) for w in some if w["line"] in sets]
    tokens, calls = line_dedup.line_tokens, []
    monkeypatch.setattr(line_dedup, "line_tokens", lambda lines: calls.append(len(lines)) or tokens(lines))
    assert list(line_dedup.wanted_sets(list(range(len(texts))), texts, wanted)) == want and len(calls) == 1
    monkeypatch.setattr(line_dedup, "BLOCK", 50)
    assert list(line_dedup.wanted_sets(list(range(len(texts))), texts, wanted)) == want and len(calls) > 5


def test_line_dedup_of_repeated_and_null_ids(spark):
    a, b, c, d = ("\n".join(f"{x} line {i} of so many words {x}{i}" for i in range(3)) for x in "abcd")
    rows = [(1, a), (7, f"{a}\n{b}"), (7, f"{c}\n{d}"), (8, f"{d}\n{d}"), (None, a), (None, a), (9, None), (9, ""), (10, c), (10, c)]
    given = spark.createDataFrame([(i, t, 5, "mine", "x") for i, t in rows], "doc_id long, text string, n_lines int, gone string, Lines string")
    got = line_dedup.dedup(given.repartition(3))
    assert sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in got.collect()), key=str) == sorted([(1, a, 0), (7, b, 3), (7, f"{c}\n{d}", 0), (8, "", 6), (None, a, 0), (None, a, 0), (9, None, 0), (9, "", 0), (10, "", 3), (10, "", 3)], key=str)
    left = line_dedup.cleaned(given)
    assert left.columns == given.columns and {(r["n_lines"], r["gone"], r["Lines"]) for r in left.collect()} == {(5, "mine", "x")}
    assert sorted((r["doc_id"] for r in left.collect()), key=str) == sorted([1, 7, 7, None, None, 9, 9], key=str)


def test_substring_dedup(docs, rows, empty):
    seen, want = set(), {}
    for i, t, *_ in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        starts = [b[k : k + 50] for k in range(len(b) - 49)]
        for k, w in enumerate(starts):
            if w in seen:
                gone[k : k + 50] = b"\1" * 50
        seen.update(starts)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        want[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substring_dedup.without_repeats(docs).collect()}
    assert got == want
    assert substring_dedup.without_repeats(empty).count() == 0


def test_substring_dedup_of_texts_longer_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK", 700)
    texts = [prose(random.Random(5), 400), "x" + prose(random.Random(5), 400)[300:], prose(random.Random(6), 300)]
    found = [list(zip(*(x.tolist() for x in m))) for m in substring_dedup._minimised([t.encode() for t in texts])]
    monkeypatch.setattr(substring_dedup, "BLOCK", 1 << 22)
    whole = [list(zip(*(x.tolist() for x in m))) for m in substring_dedup._minimised([t.encode() for t in texts])]
    assert {(k, at, g) for m in found for k, at, g, _ in m} == {(k, at, g) for m in whole for k, at, g, _ in m}


def test_substring_dedup_splits_hot_minimisers(monkeypatch):
    """A minimiser with more surroundings than fit into one suffix array: the same runs, from parts."""
    r = np.random.default_rng(2)
    around = r.integers(97, 99, (60, substring_dedup.REACH)).astype(np.uint8)
    around[:, 34:50] = 65
    for k in range(20, 60):
        a, other = sorted(r.integers(0, 84, 2))
        around[k, a:other] = around[r.integers(0, 20), a:other]
        around[k, 20:67] = around[k % 20, 20:67] if k % 2 else around[k, 20:67]
    around[:, 34:50] = 65
    doc = np.arange(60)

    def covered(parts):
        mask = np.zeros(around.shape, bool)
        for part in parts:
            for of, a, b in zip(*substring_dedup.repeated_runs(around[part], doc[part])):
                mask[part[of], a:b] = True
        return mask

    whole = covered([doc])
    monkeypatch.setattr(substring_dedup, "SHARD", 10 * substring_dedup.REACH)
    parts = list(substring_dedup._shards(around, doc, np.array([0])))
    assert len(parts) > 3 and max(map(len, parts)) < 60 and whole.any()
    assert (covered(parts) == whole).all()


def test_substring_dedup_sorts_only_what_may_repeat(monkeypatch):
    """Surroundings that differ from all others' close to the minimiser don't go into suffix arrays, and no string that two documents have is lost by that."""
    r = np.random.default_rng(5)
    n, size, reach = 300, substring_dedup.SIZE, substring_dedup.REACH
    around = r.integers(97, 123, (n, reach)).astype(np.uint8)
    around[:, 34:50] = 65
    for k in range(120, n):  # of 48 to 52 bytes in common with an earlier one, at any place about the minimiser
        a, length = r.integers(0, 35), r.integers(48, 53)
        around[k, a : a + length] = around[r.integers(0, 60), a : a + length]
    doc = np.arange(n) // 2
    some = substring_dedup.may_repeat(around, doc)

    def strings(rows):
        return {(k, c): around[k, c : c + size].tobytes() for k in rows for c in range(reach - size + 1)}

    owners: dict = {}
    for (k, c), string in strings(range(n)).items():
        owners.setdefault((c, string), set()).add(int(doc[k]))
    wanted = {k for (k, c), string in strings(range(n)).items() if len(owners[c, string]) > 1}
    assert wanted and wanted <= set(some.tolist()) and not set(some.tolist()) & set(range(60, 120))  # nobody has anything of those
    one = substring_dedup.may_repeat(around[:1], doc[:1]), substring_dedup.may_repeat(around[:0], doc[:0])
    assert [len(x) for x in one] == [0, 0]

    sorted_bytes, asked = [], substring_dedup.suffix_array
    monkeypatch.setattr(substring_dedup, "suffix_array", lambda data, depth: sorted_bytes.append(len(data)) or asked(data, depth))

    class Frame:
        def mapInArrow(self, f, schema):  # noqa: N802
            ids, crcs = doc.astype(np.int64), np.zeros(n, np.uint32)
            return list(f(list(substring_dedup.pack(1, np.zeros(n, np.uint64), np.arange(n), [ids, crcs], [np.full(n, 34, np.int32), around.view(f"V{reach}").ravel()]))))

    got = np.zeros((n // 2 + 1, reach), bool)
    for batch in substring_dedup.shard_runs(Frame(), 1):
        for blob in batch.column("blob").to_pylist():
            (ids, _), owner, (begin, end) = substring_dedup.packed([blob], *substring_dedup.RUNS)
            for k, a, b in zip(ids[owner].tolist(), begin.tolist(), end.tolist()):
                got[k, a:b] = True
    want = np.zeros_like(got)
    for (k, c), string in strings(range(n)).items():
        if min(owners[c, string]) < doc[k]:
            want[doc[k], c : c + size] = True
    assert (got == want).all() and sum(sorted_bytes) == len(some) * (reach + 1) < n * (reach + 1)


@pytest.mark.parametrize("trial", range(20))
def test_suffix_array(trial):
    r = np.random.default_rng(trial)
    data = r.integers(97, 97 + r.integers(1, 4), r.integers(1, 300)).astype(np.uint8)
    data = np.tile(data[: max(1, len(data) // 3)], 3) if trial % 2 else data
    b, order = data.tobytes(), suffix_array(data, 50)
    assert sorted(order.tolist()) == list(range(len(b)))
    prefixes = [b[i : i + 50] for i in order]
    assert prefixes == sorted(prefixes)
    shared = common_prefixes(data, order, 50)
    for x, y in zip(order[:-1], order[1:]):
        n = next((k for k in range(50) if b[x + k : x + k + 1] != b[y + k : y + k + 1] or x + k >= len(b) or y + k >= len(b)), 50)
        assert shared[y] == n


def test_packing(spark, docs, rows, empty):
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    special = [(5000, "a<|endoftext|>b <|endoftext|>"), (5001, "<|endoftext|>"), (5002, "<|endoftext|"), (5003, "x \n<|endoftext|>  y")]
    rows = rows + special
    got = packing.pack(docs.select("doc_id", "text").unionByName(spark.createDataFrame(special, "doc_id long, text string"))).toPandas()
    by_doc = {d: g.sort_values("piece") for d, g in got.groupby("doc_id")}
    for i, text, *_ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        g = by_doc[i]
        assert g["piece"].tolist() == list(range(len(g))) and g["length"].sum() == len(ids) and (g["length"].iloc[1:] == 1024).all() and g["length"].max() <= 1024
        for start, length, crc in zip(g["start"], g["length"], g["ids_crc32"]):
            assert zlib.crc32(ids[start : start + length].tobytes()) == crc
    packed = got.sort_values(["sequence_id", "offset"])
    assert (packed.groupby("sequence_id")["length"].cumsum() - packed["length"] == packed["offset"]).all()
    assert packed.groupby("sequence_id")["length"].sum().max() <= 1024
    assert packed["sequence_id"].nunique() <= -(-packed["length"].sum() // 1024) + 1
    assert packing.pack(empty).count() == 0
    odd = packing.pack(spark.createDataFrame([(None, "a b"), (None, None), (4, "a b"), (4, "a b")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["length"]) for r in odd if r["doc_id"]) == [(4, 3), (4, 3)] and sorted(r["length"] for r in odd if r["doc_id"] is None) == [1, 3]


def test_best_two_fit_beats_greedy():
    slots = packing.plan_bins({6: 1, 5: 2, 4: 2, 3: 2}, 10)
    assert max(s[3] for s in slots) + 1 == 3  # 6+4, 5+5, 4+3+3
    r = random.Random(2)
    for _ in range(20):
        counts = Counter(r.randint(1, 50) for _ in range(200))
        slots = packing.plan_bins(dict(counts), 50)
        assert sum(hi - lo for _, lo, hi, _, _ in slots) == 200


def test_mixing(spark, docs, empty):
    labelled = docs.select("doc_id", F.when(F.length("text") > 300, "long").otherwise("short").alias("domain"))
    mixed = mixing.mix(docs, labelled, {"long": 0.6, "short": 0.4}, 0.0, 50.0)
    assert mixed.columns == [c for c in docs.columns if c != "tokens"] + ["tokens", "domain", "posterior", "rate", "copies"]
    p = mixed.toPandas()
    assert p["rate"].min() >= 0 and (abs(p["copies"] - p["rate"]) < 1).all()
    total = (p["rate"] * p["tokens"]).sum()
    assert abs(total / p["tokens"].sum() - 1) < 0.05
    again = mixing.mix(docs, labelled, {"long": 0.6, "short": 0.4}, 1.0, 3.0, 1.3).toPandas()
    assert again["rate"].between(1, 3).all() and (again["copies"] >= 1).all()
    assert mixing.mix(docs, labelled.where("false"), {"long": 1.0}).where("rate <> 1 or copies <> 1").count() == 0
    assert mixing.mix(empty, labelled, {"long": 1.0}).count() == 0 and mixing.repeated(empty, labelled, {"long": 1.0}).count() == 0
    one = mixing.mix(docs, labelled.withColumn("domain", F.lit("long")), {"long": 1.0, "none": 2.0})
    assert {r["domain"] for r in one.collect()} == {"long"}


@pytest.fixture(scope="module")
def topics(spark):
    """Documents of 20 topics, each with words of its own, and their labels."""
    r = random.Random(21)
    rows = []
    for i in range(800):
        k = i % 20
        rows.append((i, " ".join(f"{k:02d}topic" if r.random() < 0.08 else r.choice(VOCABULARY) for _ in range(r.randint(20, 120))), f"t{k}"))
    return spark.createDataFrame(rows, "doc_id long, text string, domain string").repartition(3).cache()


def test_mixing_learns_domains_from_words(topics):
    """Of 20 domains those with a target are kept, whichever they are, the others are one; documents that were not learned from are told by their words."""
    targets = {"t0": 1.0, "t17": 1.0, "t18": 1.0, "t19": 3.0}
    found = mixing.mix(topics.withColumnRenamed("domain", "Truth").withColumn("Rate", F.lit(1)), topics.where("doc_id div 20 % 4 <> 0").select("doc_id", "domain"), targets, hi=20.0)
    assert "Rate" not in found.columns
    p = found.toPandas()
    held = p[p["doc_id"] // 20 % 4 == 0]
    truth = [t if t in targets else mixing.OTHER for t in held["Truth"]]
    assert (held["domain"] == truth).mean() > 0.9 and set(p["domain"]) == {*targets, mixing.OTHER}
    share = (p["rate"] * p["tokens"]).groupby(p["domain"]).sum() / p["tokens"].sum()
    assert abs(share[["t0", "t17", "t18", "t19"]].to_numpy() - [1 / 6, 1 / 6, 1 / 6, 1 / 2]).max() < 0.05 and share[mixing.OTHER] < 0.1


def test_mixing_totals_against_brute_force_by_domain(topics):
    """Totals of each domain against non-negative least squares over all rates, from the posteriors of the operator itself."""
    labelled = topics.select("doc_id", F.when(F.col("doc_id") % 20 < 8, "a").when(F.col("doc_id") % 20 < 15, "b").otherwise("c").alias("domain"))
    targets, kept = {"a": 0.2, "b": 0.5, "c": 0.3}, {}

    def spy(state, names, aims, lo, hi, fit=mixing.fit_rates):
        kept.update(state=state.toPandas(), aims=aims)
        return fit(state, names, aims, lo, hi)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(mixing, "fit_rates", spy)
        p = mixing.rates(topics, labelled, targets, 0.0, 3.0).toPandas()
    n, q = kept["state"]["tokens"].to_numpy(), kept["state"][["_p0", "_p1", "_p2"]].to_numpy()
    inverse, x = np.linalg.inv((q * n[:, None]).T @ q), np.ones(len(n))
    y = x
    for k in range(1, 3001):
        z = np.clip(y - q @ inverse @ ((y * n) @ q - kept["aims"]), 0, 3)
        x, y = z, z + k / (k + 3) * (z - x)
    brute = (x * n) @ q / n.sum()
    assert abs(brute - [0.2, 0.5, 0.3]).max() < 0.01
    share = (p["rate"] * p["tokens"]).groupby(p["domain"]).sum() / p["tokens"].sum()  # posteriors are sharp here
    assert abs(share[["a", "b", "c"]].to_numpy() - brute).max() < 0.03


@pytest.mark.parametrize("lo, hi, weights", [(0.0, 4.0, (0.3, 0.3, 0.4)), (1.0, 3.0, (0.9, 0.6, 0.1))])
def test_mixing_rates_are_the_bounded_least_squares(spark, lo, hi, weights):
    r = np.random.default_rng(11)
    p = r.dirichlet((2.0, 0.7, 0.2), 300)
    n = r.integers(1, 400, 300).astype(float)
    aims = np.array(weights) * n.sum()
    state = spark.createDataFrame([(float(a), *map(float, q)) for a, q in zip(n, p)], "tokens double, a double, b double, c double").coalesce(1).cache()
    shift = mixing.fit_rates(state, ["a", "b", "c"], aims, lo, hi)
    inverse = np.linalg.inv((p * n[:, None]).T @ p)
    objective = lambda x: (d := (x * n) @ p - aims) @ inverse @ d / n.sum()
    x = y = np.clip(np.ones(300), lo, hi)
    for k in range(1, 5001):  # accelerated projected gradient, on all rates at once
        z = np.clip(y - p @ inverse @ ((y * n) @ p - aims), lo, hi)
        x, y = z, z + k / (k + 3) * (z - x)
    found = np.clip(1 - p @ shift, lo, hi)
    assert objective(found) <= objective(x) + 1e-4


def tagged(r, lang, n=60):
    return " ".join("".join(r.choices(SYLLABLES[lang].split(), k=r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def tagged_docs(spark):
    r = random.Random(4)
    rows = [(i, tagged(r, lang := r.choice(list(SYLLABLES))), lang) for i in range(240)]
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "12 34 !!", "de"), (1003, tagged(r, "fr", 20000), None), (1004, "der und", "de"), (1004, "der und", "de")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).cache()


def test_language(tagged_docs, empty):
    found = language.identify(tagged_docs.withColumn("score", F.lit("clash"))).toPandas()
    assert len(found) == 246 and (found["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in found["doc_id"]]).all()
    truth = tagged_docs.toPandas().drop_duplicates("doc_id").set_index("doc_id")["lang"]
    held = found[found["held_out"] & (found["doc_id"] < 1000)]
    assert (held["lang_pred"].tolist() == truth[held["doc_id"]]).mean() > 0.95
    odd = found.drop_duplicates("doc_id").set_index("doc_id")
    assert odd.loc[[1000, 1001, 1002], "lang_pred"].tolist() == ["und"] * 3 and odd.loc[1003, "lang_pred"] == "fr" and odd["score"].between(0, 1).all()
    assert language.identify(empty).count() == 0
    assert set(r["lang_pred"] for r in language.identify(tagged_docs.withColumn("lang", F.lit(None).cast("string"))).collect()) == {"und"}


def test_samples_have_every_label(spark):
    from sparklode.llm import _common

    rows = spark.range(900).select(F.col("id").alias("doc_id"), (F.col("id") % 90).cast("string").alias("label"))
    got = Counter(label for _, label in _common.sample_ids(rows, 5))
    assert len(got) == 90 and set(got.values()) == {5}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(_common, "MOST_LABELS", 89)
        with pytest.raises(ValueError, match="89 labels"):
            _common.sample_ids(rows, 5)
        m.setattr(_common, "MOST_LABELS", 100)
        m.setattr(_common, "SAMPLE_BYTES", 90 * 25)
        texts = rows.select("doc_id", F.lit("ten bytes!").alias("text"))
        assert set(Counter(label for label, _ in _common.sample_texts(texts, rows, 5)).values()) == {2}


def test_toxicity(spark, empty):
    r = random.Random(8)
    words = [prose(r, 1).strip() for _ in range(400)]
    rows, labels = [], []
    for i in range(700):
        own, bad = r.choices(words, k=50), r.random() < 0.4
        for _ in range(3 * bad):
            own[r.randrange(50)] = r.choice(("grumbler", "nastyword", "spiteful"))
        rows.append((i, " ".join(own)))
        labels.append((i, int(bad), 1))
    rows += [(900, None), (901, ""), (902, "nastyword " * 9000)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    found = toxicity.toxicity(docs, labels).toPandas().set_index("doc_id")
    truth = labels.toPandas().set_index("doc_id")["toxic"]
    held = found[found["held_out"] & (found.index < 900)]
    assert (held["predicted"] == truth[held.index]).mean() > 0.97 and found["score"].between(0, 1).all() and len(found) == 703
    kept = toxicity.without_toxic(docs, toxicity.learn(docs, labels))
    assert kept.columns == docs.columns and 902 not in {x["doc_id"] for x in kept.collect()}
    assert toxicity.toxicity(docs, labels.where("toxic = 0")).where("score <> 0").count() == 0
    assert toxicity.toxicity(empty, labels).count() == 0
    one = labels.orderBy(F.desc("toxic"), "doc_id").limit(1).unionByName(labels.where("toxic = 0").limit(9))
    assert toxicity.learn(docs, one) is not None  # a single toxic document is learned from
    odd = spark.createDataFrame([(None, "a b", "x"), (5, "a b", "x"), (5, "a b", "x")], "doc_id long, text string, score string")
    scores = toxicity.score(odd, toxicity.learn(docs, labels)).collect()
    assert len(scores) == 3 and len({r["score"] for r in scores}) == 1


def test_toxic_dictionary_is_of_running_text():
    """What toxic documents share beyond ordinary ones gets cheap by the toxic dictionary, anywhere in a window, and what both share costs alike."""
    r = random.Random(31)
    plain = [" ".join(r.choices(VOCABULARY, k=120)) for _ in range(300)]
    nasty = ["grumbler of", "you spiteful", "rottenheart"]
    toxic = [" ".join(r.choice(nasty) if r.random() < 0.05 else r.choice(VOCABULARY) for _ in range(120)) for _ in range(300)]
    model = toxicity.fit([("0", t) for t in plain] + [("1", t) for t in toxic])
    assert all(w in model["toxic"] for w in (b"grumbler of", b"spiteful", b"rottenheart"))
    distance = toxicity.Distance(model)
    clean = [w for t in plain[:100] for w in toxicity.windows(t)]
    assert abs(distance(clean).mean()) < 0.3
    marked = [w.replace(b" ", b" rottenheart ", 2) for w in clean]
    assert distance(marked).mean() > 4


def test_quality(spark, empty):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        good = r.random() < 0.6
        text = prose(r, 40) if good else " ".join([r.choice(VOCABULARY) + "###"] * 40)
        rows.append((i, text, f"h{i % 7}" if i % 11 else None, f"h{i % 7}/{i % 13}", "clash"))
        labels.append((i, int(good), 0))
    rows += [(900, None, "h1", "h1/1", ""), (901, "", "new", "new/1", ""), (900, None, "h1", "h1/1", "")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, host string, path string, score string").repartition(3), spark.createDataFrame(labels[:400], "doc_id long, quality int, toxic int")
    found = quality.quality(docs, labels).toPandas()
    assert len(found) == 603 and found["score"].between(0, 1).all()
    new = found[(found["doc_id"] >= 400) & (found["doc_id"] < 600)].set_index("doc_id")
    assert (new["predicted"] == [int("###" not in rows[i][1]) for i in new.index]).mean() > 0.97
    assert quality.quality(docs, labels.where("false")).where("score <> 0.5").count() == 0
    assert quality.quality(empty.select("doc_id", "text", F.col("source").alias("host"), F.col("source").alias("path")), labels).count() == 0


def test_sparse_sites_are_shrunk(spark):
    rows = [("big", "big/a", 1)] * 80 + [("big", "big/a", 0)] * 20 + [("poor", "poor/a", 0)] * 60 + [("small", "small/a", 0)]
    known, rate = quality.sites(spark.createDataFrame(rows, "host string, path string, quality int"))
    by = {r["path"]: r["posterior"] for r in known.collect()}
    assert by["poor/a"] < by["small/a"] < rate < by["big/a"] < 0.81


def test_fingerprints(docs, rows, empty):
    found = {r["doc_id"]: r for r in fingerprints.fingerprints(docs).collect()}
    ordered = sorted((i, t or "") for i, t, *_ in rows)
    for k, (i, t) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert (found[i]["n_chars"], found[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
    prints = {}
    for i, t in ordered:
        prints.setdefault(t, set()).add(found[i]["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())

    def jaccard(a, b):
        pairs = lambda t: Counter(zip(t.lower().split(), [*t.lower().split()[1:], ""]))
        a, b = pairs(a), pairs(b)
        return sum((a & b).values()) / max(1, sum((a | b).values()))

    errors = []
    for k, (i, t) in enumerate(ordered[:-1]):
        half, after = len(t) // 2, ordered[k + 1][1]
        if len(t.split()) > 30:
            errors.append(found[i]["near_edited"] - jaccard(t, t[: len(t) - half] + after[:half]))
            errors.append(found[i]["near_next"] - jaccard(t, after))
    assert abs(np.mean(errors)) < 0.03 and np.mean(np.abs(errors)) < 0.08
    assert fingerprints.fingerprints(empty).count() == 0


def test_fingerprints_of_skewed_weights(spark):
    """A heavy term counts by its weight: for texts of one, two or four heavy pairs among many light ones."""
    def text(heavy, n, light):
        return " ".join([*(w for h in heavy for w in [h] * n), *light])

    r, texts, true = random.Random(12), [], []
    pairs = lambda t: Counter(zip(t.split(), [*t.split()[1:], ""]))
    for k in range(60):
        heavy = [f"h{k}x{i}" for i in range(r.choice((1, 2, 4)))]
        both = [text(heavy, r.choice((100, 400, 1000)), [f"{side}{k}x{i}" for i in range(r.choice((20, 63, 150)))]) for side in "ab"]
        a, b = map(pairs, both)
        true.append(sum((a & b).values()) / sum((a | b).values()))
        texts += [(2 * k, both[0]), (2 * k + 1, both[1])]
    found = {x["doc_id"]: x["near_next"] for x in fingerprints.fingerprints(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    errors = np.array([found[2 * k] for k in range(60)]) - true
    assert abs(errors.mean()) < 0.03 and np.abs(errors).mean() < 0.07 and np.abs(errors).max() < 0.3


def test_fingerprints_of_extreme_ids_and_balanced_ranges(spark):
    ends = [(-(1 << 63), "first one"), ((1 << 63) - 1, "last one"), ((1 << 63) - 1, "last two"), (None, "no id"), (None, None), (0, "middle part")]
    found = fingerprints.fingerprints(spark.createDataFrame(ends, "doc_id long, text string")).collect()
    assert len(found) == 6
    ids = spark.range(3000).select(F.when(F.col("id") == 0, F.lit((1 << 62))).otherwise(F.col("id")).alias("key"), F.xxhash64("id").alias("hash"))
    sizes = [r["count"] for r in fingerprints.ranges(ids)[0].groupBy("range").count().collect()]
    assert len(sizes) > 15 and max(sizes) < 1000  # one id far off doesn't widen the ranges
    tied = spark.range(3000).select(F.lit(5).cast("long").alias("key"), F.xxhash64("id").alias("hash"))
    assert fingerprints.ranges(tied)[0].groupBy("range").count().count() > 15


def test_fingerprints_cross_ranges_and_ties(spark):
    rows = [(i * 997, f"word{i} other{i} third{i}") for i in range(350)] + [(997, "again one"), (None, "nothing known")]
    found = sorted(fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, 0))
    ordered = sorted(((i is not None, i or 0, t) for i, t in rows))
    want = []
    for k, (_, _, t) in enumerate(ordered):
        half, after = len(t) // 2, ordered[(k + 1) % len(ordered)][2]
        want.append(hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest())
    assert sorted(r["edited_sha256"] for r in found) == sorted(want)


def test_fingerprints_by_many_split_points(spark, monkeypatch):
    r = random.Random(13)
    points = sorted({(r.choice([-(1 << 63), -7, 0, 7, r.randrange(-(1 << 62), 1 << 62)]), r.randrange(-(1 << 63), 1 << 63)) for _ in range(600)})
    rows = [*points[::5], *((k, h - 1) for k, h in points[::7]), *((k, h + 1) for k, h in points[::7]), (-(1 << 63), -(1 << 63)), ((1 << 63) - 1, (1 << 63) - 1)]
    got = fingerprints.with_range(spark.createDataFrame(rows, "key long, hash long"), points).collect()
    assert len(got) == len(rows) and all(x["range"] == bisect.bisect_right(points, (x["key"], x["hash"])) for x in got)
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 2)
    texts = spark.createDataFrame([(i, prose(r, 8)) for i in range(700)], "doc_id long, text string")
    assert len(fingerprints.fingerprints(texts)._jdf.queryExecution().optimizedPlan().toString()) < 400_000  # the search is not written out for each step


def test_media(spark):
    r = np.random.default_rng(5)
    tune = lambda notes: np.concatenate([np.sin(2 * np.pi * 220 * 2 ** (n / 12) * np.arange(250) / 2000) * np.hanning(250) for n in notes])
    song = r.integers(0, 12, 60)
    pcm = lambda x: (x * 12000).astype("<i2").tobytes()
    rows = [(20, pcm(tune(song)), 2000), (1, pcm(tune(song)), 2000), (2, pcm(tune(np.r_[r.integers(0, 12, 8), song])), 2000), (3, pcm(tune(r.integers(0, 12, 60))), 2000), (40, pcm(tune(r.integers(0, 12, 60))), 2000), (60, None, 2000), (80, b"\0", None), (100, pcm(tune(song) + r.normal(0, 0.002, 15000)), 2000)]
    found = {x["id"]: x for x in media.align(spark.createDataFrame(rows, "id long, audio binary, rate int"), F.col("id") % 20 == 0).collect()}
    assert set(found) == {20, 40, 60, 80, 100}
    assert (found[20]["class_id"], found[20]["best_id"], found[20]["best_offset"], found[20]["best_error"]) == (1, 1, 0, 0.0) and found[20]["n_matches"] >= 2
    assert found[40]["n_matches"] == 0 and found[60]["n_frames"] == 0 and found[60]["best_id"] == 80
    assert found[100]["n_matches"] >= 2 and found[100]["best_id"] in (1, 20)
    assert media.align(spark.createDataFrame([], "id long, audio binary, rate int"), F.col("id") % 20 == 0).count() == 0


def test_media_finds_what_brute_force_finds(spark):
    """Noisy and cut copies of tunes against an alignment of all pairs at all offsets: at least 0.9 of the matches, and no other."""
    r = np.random.default_rng(15)
    tones = [np.sin(2 * np.pi * 220 * 2 ** (n / 12) * np.arange(125) / 2000) * np.hanning(125) for n in range(12)]
    tunes = [np.concatenate([tones[n] for n in r.integers(0, 12, 64)]) for _ in range(40)]
    sounds = {}
    for i, tune in enumerate(tunes):
        sounds[100 + i] = tune
        noise = np.sqrt((tune**2).mean() / 10 ** (r.choice((3, 6, 10)) / 10))
        copy = tune + r.normal(0, noise, len(tune))
        sounds[20 * i + 2000] = copy if i % 2 else copy[64 * 16 :]
    rows = [(k, (v * 8000).clip(-32768, 32767).astype("<i2").tobytes(), 2000) for k, v in sounds.items()]
    prints = {k: media.fingerprint(np.frombuffer(a, "<i2"), 2000) for k, a, _ in rows}

    def aligned(a, b):
        least = 1.0
        for at in range(-30, 31):
            x, y = a[max(0, at) :], b[max(0, -at) :]
            if (n := min(len(x), len(y))) > 60:
                least = min(least, np.bitwise_count(x[:n] ^ y[:n]).sum() / (32 * n))
        return least <= media.MOST_ERRORS

    asked = [k for k in prints if k % 20 == 0]
    brute = {q: sum(aligned(prints[q], prints[k]) for k in prints if k != q) for q in asked}
    found = {x["id"]: x["n_matches"] for x in media.align(spark.createDataFrame(rows, "id long, audio binary, rate int"), F.col("id") % 20 == 0).collect()}
    assert set(found) == set(asked) and sum(brute.values()) >= 38
    assert sum(min(found[q], brute[q]) for q in asked) >= 0.9 * sum(brute.values()) and all(found[q] <= brute[q] for q in asked)


def test_media_in_blocks_against_all_keys(spark, monkeypatch):
    """Several blocks of queries, shared silence, few hits at a time, repeated ids: the same as from counting all shared keys."""
    r = np.random.default_rng(23)
    base = [r.integers(0, 1 << 32, int(r.integers(30, 90)), np.uint32) for _ in range(12)]
    prints = [(i, x) for i, x in enumerate(base)] + [(20 * i, np.r_[np.zeros(15, np.uint32), base[i][7:], np.zeros(15, np.uint32)]) for i in range(12)]
    monkeypatch.setattr(media, "BLOCK_BYTES", 1500)
    monkeypatch.setattr(media, "AT_ONCE", 300)
    monkeypatch.setattr(media, "fingerprinted", lambda df: df.select("id", F.col("audio").alias("fingerprint")))
    table = spark.createDataFrame([(i, x.astype("<u4").tobytes(), 1) for i, x in prints], "id long, audio binary, rate int")

    def wanted(a, b):
        at = Counter()
        for (k, i), (h, j) in ((x, y) for x in zip(*media.keys_of(a)) for y in by_key[id(b)].get(x[0], ())):
            at[int(i) - int(j)] += 1
        if not at or (most := max(at.values())) < media.LEAST_HITS:
            return None
        best = min((k for k, v in at.items() if v == most), key=lambda k: (abs(k), k))
        x, y = a[max(0, best) :], b[max(0, -best) :]
        n = min(len(x), len(y))
        error = np.bitwise_count(x[:n] ^ y[:n]).sum() / (32 * n)
        return (error, best) if error <= media.MOST_ERRORS else None

    by_key = {}
    for _, b in prints:
        for h, j in zip(*media.keys_of(b)):
            by_key.setdefault(id(b), {}).setdefault(h, []).append((h, j))
    expected = []
    for q, a in prints:
        if q % 20 == 0:
            near = sorted((*w, i) for i, b in prints if b is not a and (w := wanted(a, b)))
            expected.append((q, len(a), len(near)))
    found = media.align(table, F.col("id") % 20 == 0).collect()
    assert sorted((x["id"], x["n_frames"], x["n_matches"]) for x in found) == sorted(expected) and sum(e[2] for e in expected) >= 12


def test_media_of_odd_recordings(spark):
    silent = bytes(16000)
    rows = [(20, silent, 2000, "x"), (20, silent, 2000, "x"), (1, silent, 2000, "x"), (40, b"", 2000, "x"), (60, None, None, "x"), (None, silent, 2000, "x")]
    found = media.align(spark.createDataFrame(rows, "id long, audio binary, rate int, class_id string").repartition(3), F.col("id") % 20 == 0).collect()
    assert sorted((x["id"], x["n_matches"]) for x in found) == [(20, 3), (20, 3), (40, 1), (60, 1)]


def test_operators_are_native_where_asked(docs):
    labelled = docs.select("doc_id", F.lit("x").alias("domain"))
    for df in (fingerprints.fingerprints(docs), mixing.mix(docs, labelled, {"x": 1.0})):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("local", [10**6, 5])
def test_components(spark, monkeypatch, local):
    from sparklode.llm import _components

    monkeypatch.setattr(_components, "LOCAL", local)
    r = random.Random(6)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 120)]
    root = {x: x for pair in links for x in pair if pair[0] != pair[1]}
    for _ in range(130):
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = {x["id"]: x["component"] for x in _components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == root


def test_components_raise_when_rounds_run_out(spark, monkeypatch):
    from sparklode.llm import _components

    monkeypatch.setattr(_components, "LOCAL", 0)
    chain = spark.range(60).selectExpr("id as a", "id + 1 as b")
    with pytest.raises(RuntimeError, match="1 rounds"):
        _components.components(chain, rounds=1)
