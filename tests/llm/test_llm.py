"""Training-data operators against brute force, round trips and the public libraries, with awkward rows."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import ann, bpe, chat, licenses, near_dedup, packing, quality, sharding, substring, toxicity
from tideline.llm.components import components
from tideline.llm.queries import vocabulary
from tideline.llm.ranking import ranked

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", None, " \n\t ", "one", "a b", "a\x0bb\x1cc d e f", "x " * 40, "é" * 30 + " ß", "日本 語 text", "tail\n", "\n\nlines\nlines\n\nlines"]


def make(spark, texts, schema="doc_id long, text string, score double, n_words string, kept string"):
    """A table with columns that clash with those the operators add."""
    return spark.createDataFrame([(i, t, 0.5, "w", "k") for i, t in enumerate(texts)], schema)


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(words, k=rng.randint(5, 120))) for _ in range(n)]
    for i in range(0, n, 4):
        w = base[i].split()
        w[rng.randrange(len(w))] = "changed"
        base.append(" ".join(w))
        base.append(base[i])
        base.append("intro words " + base[i] + " and more")
    shared = " ".join(rng.choices(words, k=30))
    base += [f"start {k} {shared} end {k * 7}" for k in range(12)]
    rng.shuffle(base)
    return base + ODD


@pytest.fixture(scope="module")
def docs(spark):
    return make(spark, corpus()).cache()


def by_id(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def words_of(t):
    return WORD.findall(t or "")


# --- quality ------------------------------------------------------------------------------------


def test_quality_base_counts(docs):
    got = by_id(quality.repetition(docs, carry=["doc_id"]))
    for i, t in enumerate(corpus()):
        t = t or ""
        w, seen, dup = words_of(t), set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        count = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if count[tuple(w[k : k + 5])] > 1 for j in range(5)}
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)), t
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        for n in (7, 10):
            c = Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
            inside = {k + j for k in range(len(w) - n + 1) if c[tuple(w[k : k + n])] > 1 for j in range(n)}
            assert r[f"dup_chars_{n}"] == sum(len(w[k]) for k in inside)


def test_quality_keeps_rows_and_replaces_clashes(docs):
    out = quality.repetition(docs)
    assert out.count() == docs.count() and out.columns.count("kept") == 1 and dict(out.dtypes)["kept"] == "boolean"
    assert quality.repetition(docs.limit(0)).count() == 0
    twice = docs.union(docs)
    assert quality.repetition(twice, carry=["doc_id"]).count() == 2 * docs.count()


def test_hashes_of_a_long_text_are_those_of_its_words():
    from tideline.llm.words import Block

    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghé", k=rng.randint(1, 12))).encode() for _ in range(400_000)]
    text = b" ".join(words)
    assert len(text) > 2 << 20

    def block(parts):
        return Block(np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)]))

    long = block([b"before ", text, b" after"])
    long.find_words()
    some = list(range(0, len(words), 997))
    small = block([words[i] for i in some])
    small.find_words()
    assert long.n_words.tolist() == [1, len(words), 1]
    assert (long.word_hashes()[1:-1][some] == small.word_hashes()).all()


# --- near duplicates ----------------------------------------------------------------------------


def brute_components(texts, n, percent):
    sets = []
    for t in texts:
        w = [x.translate({k: k + 32 for k in range(65, 91)}) for x in words_of(t)]
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sets, [find(i) for i in range(len(sets))]


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, docs, n, percent):
    texts = corpus()
    sets, comps = brute_components(texts, n, percent)
    got = by_id(near_dedup.near_duplicates(docs, n=n, percent=percent), "id")
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), comps[i], comps[i] == i)


def test_near_duplicate_chain_is_one_component(spark):
    """Each text differs a little from the one before: far ends are linked over the middle only."""
    words = [f"t{i}" for i in range(60)]
    texts = []
    for k in range(30):
        words[2 * k] = f"new{k}"
        texts.append(" ".join(words))
    _, comps = brute_components(texts, 3, 80)
    got = by_id(near_dedup.near_duplicates(make(spark, texts), n=3, percent=80), "id")
    assert [got[i]["component_id"] for i in range(30)] == comps


def test_near_duplicates_on_empty_and_null_ids(spark):
    empty = make(spark, []).select("doc_id", "text")
    assert near_dedup.near_duplicates(empty).count() == 0
    nulls = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (4, None)], "doc_id long, text string")
    rows = near_dedup.near_duplicates(nulls).collect()
    assert len(rows) == 4 and all(r["kept"] for r in rows)


def test_estimate_is_corrected_for_chance(spark):
    rng = np.random.default_rng(0)
    m = rng.integers(0, 2**63, size=(200, 1), dtype=np.uint64)
    other = m.copy()
    other[:60] = rng.integers(0, 2**63, size=(60, 1), dtype=np.uint64)

    def packed(v):
        out = np.zeros(-(-200 // near_dedup.PER_LONG), np.uint64)
        for i in range(200):
            out[i // near_dedup.PER_LONG] |= (v[i, 0] & np.uint64(3)) << np.uint64(2 * (i % near_dedup.PER_LONG))
        return out.view(np.int64).tolist()

    row = spark.createDataFrame([(packed(m), packed(other), packed(m))], "a array<long>, b array<long>, c array<long>")
    r = row.select(near_dedup.estimate("a", "b", 200).alias("ab"), near_dedup.estimate("a", "c", 200).alias("ac"), near_dedup.equal_low_bits("a", "b", 200).alias("e")).first()
    assert r["e"] == int(((m & np.uint64(3)) == (other & np.uint64(3))).sum()) and r["ac"] == 1 and abs(r["ab"] - 0.7) < 0.12


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (7, None)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- shards -------------------------------------------------------------------------------------


def test_shards_keep_groups_and_balance(spark, docs):
    got = sharding.shard_by_size(docs, 5).collect()
    texts = corpus()
    shard_of, slots, load = {}, {}, Counter()
    for r in got:
        t = texts[r["id"]]
        assert r["size"] == len((t or "").encode()) + 8 and r["text_crc32"] == zlib.crc32((t or "").encode())
        assert shard_of.setdefault(t, r["shard"]) == r["shard"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        load[r["shard"]] += r["size"]
    assert len(got) == len(texts) and set(shard_of.values()) <= set(range(5))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) - min(load.values()) <= max(len((t or "").encode()) + 8 for t in texts) * 4
    assert sharding.shard_by_size(docs.limit(0), 5).count() == 0


def test_schedule_equals_a_plain_heap():
    rng = random.Random(1)
    jobs = sorted((rng.randint(1, 60) for _ in range(500)), reverse=True)
    load = [0] * 7
    for j in jobs:
        k = min(range(7), key=lambda s: (load[s], s))
        load[k] += j
    bins = [(v, n, v * n) for v, n in Counter(jobs).items()]
    made, count = [0] * 7, Counter()
    rows = list(sharding.schedule(bins, 7))
    for b, since, width, order in rows:
        assert since == count[b]  # a bin's rows follow each other without gaps
        for s in order:
            made[s] += b * width
            count[b] += width
    assert count == Counter(jobs) and max(made) - min(made) <= max(load) - min(load) + 2
    # A bin of many groups has few rows.
    assert len(list(sharding.schedule([(100, 10**9, 10**11), (7, 1000, 7000)], 24))) <= 6


def test_ranks_have_no_gaps(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    got = ranked(df, "k", ["id"], "r", 16).collect()
    for k in range(3):
        ranks = sorted(r["r"] for r in got if r["k"] == k)
        assert ranks == list(range(len(ranks)))


# --- tokens -------------------------------------------------------------------------------------

TRICKY = [*ODD, "it's they'll we've I'm 'sam ''s x'RE '", "a1b2  3 44\t5", "<|endoftext|> x <|startoftext|>É <|other|>", "é'sÈ × ÷", "a'll' 'tis  \n  ok\n", "İstanbul ΣΑΣ ﬁ Ⅷ ½", "ÀÉÎ ŸĀ é x", "\x00\x7f\x1c", "a" * 3000, "!!! ??? ... ---", "word " * 3000, " wide space"]


def test_packing_pieces_are_the_librarys_ids(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    texts = TRICKY + corpus()[:100]
    got = packing.pack(make(spark, texts), vocabulary("byte_bpe_50k.json"), window=256).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, t in enumerate(texts):
        ids, at = [*library.encode(t or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part)), t
            at += r["length"]
        assert at == len(ids)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    assert packing.pack(make(spark, []).select("doc_id", "text"), vocabulary("byte_bpe_50k.json")).count() == 0


def test_plan_fills_windows():
    rng = np.random.default_rng(0)
    have = np.bincount(np.minimum(rng.gamma(1.2, 500, 20_000).astype(int) + 1, 2048), minlength=2049)
    runs, n = packing.plan(have)
    placed, fill = Counter(), Counter()
    for length, since, until, first, at in runs:
        placed[length] += until - since
        for k in range(until - since):
            fill[first + k] += length
    assert placed == Counter({i: int(c) for i, c in enumerate(have) if c})
    assert max(fill.values()) <= 2048 and len(fill) == n
    assert 1 - have @ np.arange(2049) / (n * 2048) < 0.002
    assert packing.plan(np.zeros(2049, int)) == ([], 0)


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    texts = TRICKY + corpus()[:60]
    got = by_id(bpe.encode_decode(make(spark, texts), path, full=True))
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["decoded"] == library.decode(ids, skip_special_tokens=False), t
        assert got[i]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest() and got[i]["n_tokens"] == len(ids)
    assert bpe.encode_decode(make(spark, []), path).count() == 0


def test_a_block_with_more_pieces_than_are_kept(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from tideline.llm import pieces

    monkeypatch.setattr(pieces, "KEPT", 50)
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n)) for n in (40, 400, 3, 170, 1000)] + ["few words"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = vocabulary(name)
        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        engine = bpe.Codec(path) if name.startswith("word") else None
        packing._encoder.cache_clear()
        for t in texts:
            rows = engine.run(pa.array([t])) if engine else packing.token_ids(path, pa.array([t]))
            assert next(iter(rows))[1].tolist() == library.encode(t, add_special_tokens=False).ids
        table = engine.table if engine else packing._encoder(path)[1]
        assert len(table.at) == 50  # the larger table is dropped
    packing._encoder.cache_clear()


def test_trie_equals_plain_merges():
    trie = bpe.codec(vocabulary("word_bpe_49k.json")).trie
    rng = random.Random(0)
    words = list({"".join(rng.choices("etaonhrisdlu", k=rng.randint(1, 14))).encode() for _ in range(800)})
    back = {b: trie.inner[bytes([b])] for w in words for b in w}
    for word, ids in zip(words, trie.encode(words), strict=True):
        assert ids == trie.merged((*[back[b] for b in word[:-1]], trie.last[word[-1:]]))


# --- substrings ---------------------------------------------------------------------------------


def brute_removed(texts, window):
    first = {}
    for i, t in enumerate(texts):
        w = words_of(t)
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = []
    for i, t in enumerate(texts):
        w, gone = words_of(t), set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return out


@pytest.mark.parametrize(("window", "hot"), [(13, 2000), (13, 3), (4, 2000)])
def test_substrings_equal_brute_force(docs, window, hot, monkeypatch):
    monkeypatch.setattr(substring, "HOT", hot)
    monkeypatch.setattr(substring, "SHARD_WORDS", 500)
    got = by_id(substring.remove_duplicates(docs, window=window))
    for i, expected in enumerate(brute_removed(corpus(), window)):
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == expected


@pytest.mark.parametrize("hot", [2000, 3])
def test_substrings_in_documents_that_repeat_a_shared_passage(spark, hot, monkeypatch):
    """The same stretch at several places of one document; an earlier one holds its windows among other words."""
    monkeypatch.setattr(substring, "HOT", hot)
    monkeypatch.setattr(substring, "SHARD_WORDS", 500)
    rng = random.Random(5)
    fresh = lambda k: [f"v{rng.randrange(10**9)}" for _ in range(k)]
    texts = []
    for _ in range(20):
        passage, around = fresh(20), fresh(20)
        inner = passage[rng.randint(0, 3) : rng.randint(15, 20)]
        texts.append(" ".join(fresh(15) + inner + fresh(15)))
        line = around[:10] + passage + around[10:]
        texts.append(" ".join(fresh(3) + line + fresh(5) + line + line + fresh(2)))
        texts.append(" ".join(line + fresh(4) + line))
    got = by_id(substring.remove_duplicates(make(spark, texts)))
    for i, expected in enumerate(brute_removed(texts, 13)):
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == expected


def test_substrings_full_text_and_empty(spark, docs):
    full = substring.remove_duplicates(docs, full=True, carry=["doc_id", "score"])
    texts = corpus()
    for r in full.collect():
        if not r["n_removed"]:
            assert r["text"] == (texts[r["doc_id"]] or "")
    assert substring.remove_duplicates(docs.limit(0)).count() == 0


def test_substrings_leave_no_tables_of_finished_steps(docs, monkeypatch):
    """Texts of stretches and anchors lie on the disk while they are needed, and of a finished call only the spans."""
    from tideline.sources import shared

    before, most, write = len(shared._written), [], substring.stored

    def counted(df):
        most.append(len(shared._written) - before)
        return write(df)

    monkeypatch.setattr(substring, "stored", counted)
    got = by_id(substring.remove_duplicates(docs))
    assert len(got) == len(corpus()) and max(most) <= 4 and len(shared._written) - before == 1


def test_range_minimum():
    rng = np.random.default_rng(0)
    for n in (1, 5, 16, 17, 300, 2000):
        v = rng.integers(0, 50, n)
        r = substring.RangeMinimum(v)
        lo = rng.integers(0, n, 500)
        hi = np.minimum(lo + rng.integers(1, n + 1, 500), n)
        assert r.of(lo, hi).tolist() == [v[a:b].min() for a, b in zip(lo, hi, strict=True)]


def test_backward_search_counts():
    rng = np.random.default_rng(0)
    codes = np.append(rng.integers(1, 5, 300), 0)
    index = substring.FMIndex(codes, np.zeros(301, np.int64), 4)
    for p in range(290):
        lo, hi = np.zeros(1, np.int64), np.full(1, index.n)
        for k in (2, 1, 0):
            lo, hi = index.step(lo, hi, codes[p + k : p + k + 1])
        assert hi[0] - lo[0] == sum(1 for q in range(298) if (codes[q : q + 3] == codes[p : p + 3]).all())


def test_matching_statistics_equal_brute_force():
    rng = np.random.default_rng(3)
    texts = [rng.integers(1, 4, rng.integers(1, 25)) for _ in range(40)]
    owner = rng.integers(0, 12, 40)
    codes = np.concatenate([np.append(t, 0) for t in texts])
    at = np.cumsum([0, *[len(t) + 1 for t in texts]])[:-1]
    index = substring.FMIndex(codes, np.repeat(owner, [len(t) + 1 for t in texts]), 3)
    of = np.repeat(np.arange(40), [len(t) for t in texts])
    end = np.concatenate([a + 1 + np.arange(len(t)) for a, t in zip(at, texts, strict=True)])
    got = index.matching_statistics(codes, at[of], end, owner[of])
    held = lambda run, other: any(other[i : i + len(run)] == run for i in range(len(other) - len(run) + 1))
    for k, e, n in zip(of, end - at[of], got, strict=True):
        mine, before = texts[k].tolist(), [texts[j].tolist() for j in range(40) if owner[j] < owner[k]]
        assert n == max([m for m in range(1, e + 1) if any(held(mine[e - m : e], t) for t in before)], default=0)


# --- neighbours ---------------------------------------------------------------------------------


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 32)).astype(np.float32)
    x[300:] = x[:300] + 0.2 * rng.normal(size=(300, 32))
    x[7] = x[8]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, []), (1020, [0.0] * 32), (1040, [float("nan")] * 32), (1060, [1.0] * 31 + [None]), (None, [1.0] * 32), (1080, [1.0, 2.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append(r)
    assert set(found) == set(range(0, 600, 20))
    y, hit = x.astype(float), 0
    for q, rs in found.items():
        s = (y * y[q]).sum(axis=1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(600), -s))[:20]
        rs.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rs] == list(range(1, 21)) and all(abs(r["score"] - s[r["vec_id"]]) < 1e-9 for r in rs)
        hit += len({r["vec_id"] for r in rs} & set(best.tolist()))
    assert hit / (20 * len(found)) >= 0.99
    few = ann.nearest(spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")).collect()
    assert sorted((r["query_id"], r["rank"]) for r in few) == [(0, 1), (0, 2)]
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_estimates_keep_within_their_bounds():
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(500, 64)), rng.normal(size=(20, 64))
    turn = ann.rotation(64)
    codes, norm, fit, power = ann.encode(x, turn)
    columns = np.ascontiguousarray(codes.T)
    for v in q:
        guess, width = ann.estimates(v, turn, columns, ann.ones_of(columns), np.ldexp(norm, power), fit)
        assert (np.abs(guess - x @ v) <= width).mean() > 0.99
        assert np.abs(guess - x @ v).mean() < 0.3 * width.mean() * 3


def plain_nearest(x, every, k):
    """By loops over doubles: sums in order, ties to the smaller id, what is no number last."""
    out = {}
    with np.errstate(all="ignore"):
        for i in range(0, len(x), every):
            s = [(float(np.cumsum(x[i] * v)[-1]), j) for j, v in enumerate(x) if j != i]
            s.sort(key=lambda t: (t[0] != t[0], -t[0] if t[0] == t[0] else 0, t[1]))
            out[i] = [j for _, j in s[:k]]
    return out


@pytest.mark.parametrize("scale", [1.0, 1e30, 1e-30, 1e160, 1e-160, 1e-170, 1e300, "mixed"])
def test_neighbours_of_large_and_tiny_vectors(spark, scale):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 16))
    x[60] = x[61] = x[3]  # ties
    x = x * 10.0 ** rng.integers(-60, 60, size=(120, 1)) if scale == "mixed" else x * scale
    got = {}
    for r in ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), every=20, k=10).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    expected = plain_nearest(x, 20, 10)
    assert set(got) == set(expected) and all(len(v) == 10 for v in got.values())
    hit = sum(len(set(got[i]) & set(expected[i])) for i in got)
    assert hit >= 0.95 * 10 * len(got), hit


# --- chats --------------------------------------------------------------------------------------

CHATS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello \\ there"),
    (2, 0, "user", "</s>[INST] ok [/INST]"), (2, 1, "assistant", "</s>[INST] ok [/INST] <</SYS>"),
    (3, 0, "assistant", "first"), (3, 1, "user", None), (3, 2, "tool", "x[/ROLE]y"), (3, 3, None, "z<"),
    (4, 0, "user", "\\"), (4, 1, "assistant", "tail [/INS"), (4, 1, "assistant", "tail [/INS"), (None, 0, "user", "no id"),
]


def test_chats_round_trip(spark):
    rows = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string")
    formatted = chat.format_chats(rows)
    machine = chat.Formatter(chat.Template())
    for r in formatted.collect():
        turns = [(x[2] or "", x[3] or "") for x in CHATS if x[0] == r["conv_id"]]
        assert machine.parse(r["formatted"]) == turns
        assert r["segments"][0]["start"] == 0 and r["segments"][-1]["end"] == len(r["formatted"])
        assert all(a["end"] == b["start"] for a, b in zip(r["segments"], r["segments"][1:], strict=False))
        loss = "".join(machine.unescaped(r["formatted"][s["start"] : s["end"]]) for s in r["segments"] if s["loss"])
        assert loss == "".join(t for role, t in turns if role == "assistant")
        assert (r["first_bad_turn"] < 0) == (r["conv_id"] in (1, 2, None))
    got = by_id(chat.digests(formatted), "conv_id")
    assert got[2]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for c, _, r, t in CHATS if c == 2).encode()).hexdigest()
    assert chat.digests(chat.format_chats(rows.limit(0))).count() == 0


def test_escapes_survive_anything():
    machine = chat.Formatter(chat.Template())
    rng = random.Random(0)
    parts = [*chat.Template().marks(), "\\", "<", "[", "/", "SYS>", "a", "]"]
    for _ in range(2000):
        turns = [(rng.choice(["user", "assistant", "system", "odd"]), "".join(rng.choices(parts, k=rng.randint(0, 6)))) for _ in range(3)]
        assert machine.parse("".join(p for p, _ in machine.segments(turns)[0])) == turns


def test_a_template_needs_telling_marks():
    with pytest.raises(ValueError):
        chat.Formatter(chat.Template(other=chat.Role("[INST]", "x")))


# --- licences -----------------------------------------------------------------------------------


def plain_words(text):
    bare = re.sub(r"(?<![^\W_])[^\w\s]+|(?<![^\W_])_+|[^\w\s]+(?![^\W_])|_+(?![^\W_])", " ", (text or "").lower())
    return bare.split()


def plain_scan(texts, templates):
    """Every template against every stretch of every text."""
    shingles = lambda w: [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
    out = {}
    for name, body in templates.items():
        wanted = set(shingles(plain_words(body)))
        span = -(-len(wanted) * 5 // 4)
        for i, t in enumerate(texts):
            s = shingles(plain_words(t))
            got = [(len(wanted & set(s[p : p + span])), -p) for p in range(len(s)) if s[p] in wanted]
            if got and max(got)[0] >= 0.8 * len(wanted):
                out[i, name] = (len(wanted), max(got)[0], -max(got)[1])
    return out


def license_texts():
    rng = random.Random(8)
    noise = lambda k: " ".join(f"filler{rng.randrange(500)}" for _ in range(k))
    texts = [noise(300), "This software is good and the license permits it.", *ODD]
    for name, body in licenses.TEMPLATES.items():
        words = body.split()
        texts.append(f"{noise(rng.randint(0, 200))} {body} {noise(50)}")
        texts.append(body.upper() if len(name) % 2 else " ".join(words[: len(words) // 2]))
        broken = list(words)
        for _ in range(1 + len(words) // 40):
            broken[rng.randrange(len(words))] = "CHANGED"
        texts.append(noise(20) + "\n" + "\n".join(broken))
        wide = list(words)
        for _ in range(len(words) // 30):
            wide.insert(rng.randrange(len(words)), "inserted")
        texts.append(" ".join(wide) + " " + noise(5))
    texts.append(" ".join([*licenses.TEMPLATES.values()]))
    return texts


def test_licenses_equal_brute_force(spark):
    texts = license_texts()
    got = {(r["doc_id"], r["license"]): (r["n_template"], r["n_found"], r["first_word"]) for r in licenses.scan(make(spark, texts)).collect()}
    assert got == plain_scan(texts, licenses.TEMPLATES)
    assert licenses.scan(make(spark, [])).count() == 0
    assert licenses.scan(make(spark, texts), {}).count() == 0
    assert licenses.scan(make(spark, texts), {"none": " \n"}).count() == 0


def test_licenses_in_a_long_text_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(licenses, "SEGMENT", 64)
    mit, gpl = licenses.TEMPLATES["MIT permission"], licenses.TEMPLATES["GPL notice"]
    rng = random.Random(9)
    noise = lambda k: " ".join(f"filler{rng.randrange(500)}" for _ in range(k))
    texts = [noise(k) + " " + mit + " " + noise(700) + " " + gpl + " " + noise(90) for k in (0, 30, 63, 64, 100, 900)]
    templates = {"MIT permission": mit, "GPL notice": gpl}
    df = make(spark, texts)
    got = {(r["doc_id"], r["license"]): (r["n_template"], r["n_found"], r["first_word"]) for r in licenses.scan(df.union(df), templates).collect()}
    assert got == plain_scan(texts, templates)
    nulls = spark.createDataFrame([(None, mit), (None, gpl), (1, None)], "doc_id long, text string")
    assert sorted(r["license"] for r in licenses.scan(nulls, templates).collect()) == ["GPL notice", "MIT permission"]


# --- toxicity -----------------------------------------------------------------------------------


def test_toxicity_learns_and_sees_through_disguise(spark):
    rng = random.Random(0)
    clean = [f"word{i}" for i in range(50)] + ["morning", "garden", "river", "idol", "motor"]
    texts, labels = [], []
    for i in range(400):
        words = rng.choices(clean, k=30)
        bad = i % 4 == 0
        if bad:
            words[rng.randrange(30)] = rng.choice(["idiot", "moron", "scumbag"])
        texts.append(" ".join(words))
        labels.append((i, int(bad)))
    hidden = ["an 1d10t here", "you m.o.r.o.n you", "what an i d i o t he is", "stuff mooorrron stuff", "$cumbag indeed", "1D!OT"]
    docs = make(spark, texts + hidden + ["a calm river in the garden", "", None])
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = by_id(toxicity.scored(docs, model))
    assert all((got[i]["score"] >= 0.5) == bool(y) for i, y in labels)
    assert all(got[400 + k]["score"] >= 0.5 for k in range(len(hidden))), [got[400 + k]["score"] for k in range(len(hidden))]
    assert all(got[400 + len(hidden) + k]["score"] < 0.5 for k in range(3))
    assert toxicity.scored(docs.limit(0), model).count() == 0


@pytest.fixture(scope="module")
def sharp():
    """A model that knows three words, with letters counted over a few sentences."""
    text = " ".join(["you are a man and he is the one who said that this is not what i am to do with it"] * 20 + ["an assignment of the class"] * 5).encode()
    code = np.array([toxicity._CODE[b] for b in text], np.int64)
    grams = sum(code[k : len(code) - toxicity.ORDER + 1 + k] * toxicity.SYMBOLS ** (toxicity.ORDER - 1 - k) for k in range(toxicity.ORDER))
    counts = np.bincount(grams, minlength=toxicity.SYMBOLS**toxicity.ORDER)
    return toxicity.Model(toxicity.log_model(counts), {"=stupid": 8.0, "=idiot": 8.0, "=ass": 8.0}, -4.0)


@pytest.mark.parametrize("text", ["you are a s t u p i d man", "y o u i d i o t", "s t u p i d i d i o t", "i   d   i   o   t", "i\td\ti\to\tt", "i\nd\ni\no\nt", "a 1 d 1 0 t b", "y o u   s t u p i d   m a n", "so i i d d i i o t t i am", "x i.d.i.o.t x", "x i_d_i_o_t x", "you $ t u p ! d", "i d i " + "o " * 5000 + "t"])
def test_toxicity_parts_spaced_runs_into_words(sharp, text):
    assert sharp.score(text) > 0.5


@pytest.mark.parametrize("text", ["a n a s s i g n m e n t", "x + y = 3", "1 2 3 4 5 6", "a b c d e f g", "- - - ! ! !", ""])
def test_toxicity_leaves_other_runs(sharp, text):
    assert sharp.score(text) < 0.5


LONG_TOKENS = ["idi" + "o" * 100 + "t", "idi" + "o" * 50 + "t/" + "x" * 50, "/".join(["some", "plain", "words", "stupid", "and", "others", "more", "than", "forty"]), "first-second-third-fourth-fifth-sixth-1d10t-seventh", "one,two,three,four,five,six,seven,eight,nine,ten,id!ot", "first-second-third-fourth-fifth-sixth-455-seventh", "word1idiot2word3other4word5other6word7other8w", "455-" * 20, "idiot/stupid", "ab" * 30_000 + "-1d1ot"]


@pytest.mark.parametrize("text", LONG_TOKENS)
def test_toxicity_decodes_long_and_joined_tokens(sharp, text):
    assert sharp.score(text) > 0.5


def test_toxicity_leaves_long_tokens_of_other_words(sharp):
    assert all(sharp.score(t) < 0.5 for t in ["https://some.where.net/class/assignment/of/the/man/and/0123", "0123" * 30, "-" * 100, "ab12" * 20])


def plain_best(model, steps, border):
    """The score of the best reading of a lattice, over all choices of letters and borders."""
    from itertools import product

    n = len(steps)

    def word(letters):
        at, s = 0, 0.0
        for x in [*letters, ""]:
            z = toxicity._code(x) if x else 0
            s += float(model.language[at][z])
            at = at % toxicity.SYMBOLS ** (toxicity.ORDER - 2) * toxicity.SYMBOLS + z
        return s

    best = [0.0] * n + [0.0]
    for i in range(n - 1, -1, -1):
        found = [best[i + 1]] if steps[i][0][0] == "" else []
        for j in range(i + 1, n + 1):
            if j < n and border[j] is None:
                continue
            for picked in product(*steps[i:j]):
                letters = "".join(x for x, _ in picked)
                if letters:
                    found.append(sum(c for _, c in picked) + word(letters) + (border[j] if j < n else 0.0) + best[j])
        best[i] = max(found, default=-np.inf)
    return best[0]


def test_viterbi_finds_the_best_reading_of_a_lattice(sharp):
    rng = random.Random(4)
    model = toxicity.Model(sharp.language)
    for _ in range(150):
        chars = "".join(rng.choices("aeinst104$!.-h", k=rng.randint(1, 6)))
        border = [None, *[rng.choice([None, 0.0, toxicity.BORDER]) for _ in chars[1:]]]
        steps = model.lattice(chars)
        words, score = model.decode(steps, border)
        assert score == pytest.approx(plain_best(model, steps, border), abs=1e-4), chars
        assert not words or score > -np.inf


@pytest.mark.parametrize(("raw", "word"), [("th1$", "this"), ("m@n", "man"), ("h3", "he"), ("a55ignm3nt", "assignment"), ("s4id", "said"), ("th*t", "that"), ("as$ignment", "assignment"), ("tttthis", "this"), ("wh4t", "what")])
def test_viterbi_restores_words_that_the_classifier_does_not_know(sharp, raw, word):
    assert toxicity.Model(sharp.language).of_token(raw) == [word] and sharp.of_token(raw) == [word]


def test_words_passed_over_have_no_weight(sharp):
    """What hits() skips: decoding it in full finds nothing of weight either."""
    rng = random.Random(6)
    for _ in range(400):
        raw = "".join(rng.choices("idiotsup1045$!.-", k=rng.randint(2, 9)))
        full = {f for w in sharp.of_token(raw) for f in sharp.of_word(w) if f in sharp.weights}
        assert {f for w in sharp.of_token(raw, False) for f in sharp.of_word(w) if f in sharp.weights} == full


@pytest.mark.parametrize("text", ["=" * 10**6, "o" * 10**6, ". " * 500_000, "1" * 10**6, "-" * 10**6 + "1d1ot", "! " * 300_000])
def test_toxicity_of_a_megabyte_of_one_symbol(sharp, text):
    import time

    began = time.time()
    assert (sharp.score(text) > 0.5) == text.endswith("ot")
    assert time.time() - began < 5


def test_fit_counts_only_labels_with_a_document(spark):
    texts = [f"plain words here {i}" for i in range(40)] + ["you scumbag " + str(i) for i in range(20)]
    labels = [(i, int(i >= 40)) for i in range(60)]
    docs = make(spark, texts)
    one = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    more = toxicity.fit(docs, spark.createDataFrame([*labels, *[(1000 + i, 1) for i in range(500)], (None, 1), (3, None)], "doc_id long, toxic int"))
    assert one.weights == more.weights and one.bias == more.bias and "=scumbag" in one.weights
    assert (one.language == more.language).all()


def test_toxicity_without_labels(spark):
    docs = make(spark, ["a b", None])
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r["score"] < 0.5 for r in toxicity.scored(docs, model).collect()] == [True, True]


# --- awkward rows ----


def test_operators_on_long_repeated_and_clashing_rows(spark):
    """A text of 2.5 MB, rows and ids that occur twice, null ids, and columns named like those that are made."""
    rng = random.Random(21)
    vocab = [f"{a}{b}" for a in ("red", "blue", "green", "old", "new", "far") for b in ("stone", "river", "cloud", "lamp", "field", "door", "wind")]
    long = " ".join(rng.choices(vocab, k=300_000))
    texts = [long, "a short text of a few words that is kept by every rule", "a short text of a few words that is kept by every rule", None, ""]
    rows = [(i, t, "x", 1, True, "c", 2.0) for i, t in enumerate(texts)] + [(1, texts[1], "x", 1, True, "c", 2.0), (None, texts[1], None, None, None, None, None), (None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, size int, kept boolean, shard string, length double").repartition(2)
    n_words = {0: 300_000, 1: 13, 2: 13, 3: 0, 4: 0}
    q = quality.repetition(docs, carry=["doc_id", "size"]).collect()
    assert len(q) == 8 and all(r["n_words"] == n_words[r["doc_id"]] for r in q if r["doc_id"] is not None)
    s = substring.remove_duplicates(docs).collect()
    assert len(s) == 8 and all(r["n_words"] == n_words[r["doc_id"]] for r in s if r["doc_id"] is not None)
    d = near_dedup.near_duplicates(docs).collect()
    assert len(d) == 8 and {r["component_id"] for r in d if r["id"] in (1, 2)} == {1} and all(r["kept"] for r in d if r["id"] is None)
    t = sharding.shard_by_size(docs, 3).collect()
    assert len(t) == 8 and sum(r["size"] for r in t) == sum(len((x or "").encode()) + 8 for x in [*texts, texts[1], texts[1], None])
    p = packing.pack(docs, vocabulary("byte_bpe_50k.json")).collect()
    assert {r["doc_id"] for r in p} == {0, 1, 2, 3, 4, None} and all(r["offset"] + r["length"] <= 2048 for r in p)
    whole = [r for r in p if r["doc_id"] == 0]
    assert sum(r["length"] for r in whole) == whole[0]["doc_tokens"] > 300_000
    b = bpe.encode_decode(docs, vocabulary("word_bpe_49k.json")).collect()
    assert len(b) == 8 and {r["n_tokens"] for r in b if r["doc_id"] in (3, 4)} == {0}
    model = toxicity.fit(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"))
    assert toxicity.scored(docs, model, score="size").where("size between 0 and 1").count() == 8
    assert licenses.scan(docs).count() == 0


# --- the pipeline -------------------------------------------------------------------------------


def test_neighbours_with_clashing_columns_and_small_blocks(spark, monkeypatch):
    """Columns named like those that are made, repeated and null ids, vectors of two lengths, several blocks."""
    rng = np.random.default_rng(9)
    vectors = [(i, rng.normal(size=6 if i % 5 else 4).tolist()) for i in range(120)] + [(7, [1.0] * 6), (None, [1.0] * 6), (300, None), (301, []), (302, [0.0] * 6), (303, [1.0, None, 2.0, 3.0, 4.0, 5.0])]
    table = spark.createDataFrame([(i, v, 1, 2, "c", 0.5) for i, v in vectors], "vec_id long, embedding array<double>, id int, v int, code string, score double").repartition(3)
    plain = [(i, np.array(v)) for i, v in vectors if i is not None and v and None not in v and any(v)]
    want = {}
    for q, x in plain:
        if q % 20 == 0:
            want.setdefault(q, []).extend(sorted(((-float(np.cumsum(x * y)[-1]), i) for i, y in plain if i != q and len(y) == len(x)))[:5])
    for size in (1 << 22, 100):
        monkeypatch.setattr(ann, "BLOCK_COMPONENTS", size)
        got: dict = {}
        for r in sorted(ann.nearest(table, 20, 5).collect(), key=lambda r: (r.query_id, r["rank"])):
            got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert got == want
    assert ann.nearest(table.limit(0)).count() == 0


def test_chats_with_long_texts_and_clashing_columns(spark):
    long = "</s>[INST] word \\ " * 60_000
    rows = [(1, 0, "user", long, "t", 3), (1, 1, "assistant", long, None, None), (1, 1, "assistant", long, None, None), (None, None, None, None, None, None), (2, None, "system", "", "t", 1)]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, turns string, formatted int")
    made = chat.format_chats(table)
    got = {r["conv_id"]: r for r in chat.digests(made).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 2 * len(long) and got[None]["n_turns"] == got[2]["n_turns"] == 1
    assert got[1]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{long}\n" for r in ("user", "assistant", "assistant")).encode()).hexdigest()
    assert chat.digests(chat.format_chats(table.limit(0))).count() == 0


def pipeline_texts():
    """Clean, toxic, repetitive, nearly equal and overlapping documents, and awkward ones."""
    rng = random.Random(12)
    words = [f"{a}{b}{c}" for a in ("ta", "re", "mo", "li", "su") for b in ("n", "d", "r", "ss") for c in ("el", "or", "im", "a", "ent")]
    fresh = lambda k: [rng.choice(words) + rng.choice(words) for _ in range(k)]
    base = [fresh(rng.randint(30, 120)) for _ in range(60)]
    texts = [" ".join(b) for b in base]
    shared = fresh(40)
    texts += [" ".join(fresh(25) + shared + fresh(25)) for _ in range(5)]
    near = list(base[7])
    near[3] = "changed"
    texts += [" ".join(near), " ".join(base[9]), " ".join(base[11][:-1])]
    texts += [" ".join(fresh(20) + ["scumbag"] + fresh(20)) for _ in range(12)] + [" ".join(fresh(20) + ["$cumb@g"] + fresh(20)), " ".join([*fresh(20), "s", "c", "u", "m", "b", "a", "g", *fresh(20)])]
    texts += [" ".join(fresh(8) * 4), " ".join(w for w in fresh(60) for _ in range(4)), ("line of " + " ".join(fresh(20)) + "\n") * 3]
    return texts + [None, "", " \n", "few words only", " ".join(fresh(9000))]


def plain_kept(t):
    w, lines = words_of(t), (t or "").split("\n")
    total = max(sum(map(len, w)), 1)

    def inside(n):
        c = Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
        return {k + j for k in range(len(w) - n + 1) if c[tuple(w[k : k + n])] > 1 for j in range(n)}

    seen, dup = set(), 0
    for line in lines:
        if WORD.search(line):
            dup += sum(map(len, words_of(line))) if line in seen else 0
            seen.add(line)
    if len(w) < 10 or 100 * len(inside(5)) > 20 * len(w) or 100 * dup > quality.MAX_DUPLICATED_LINES * total:
        return False
    return all(100 * sum(len(w[k]) for k in inside(n)) <= most * total for n, most in quality.MAX_DUPLICATED.items())


def pipeline_tables(spark, tmp_path):
    texts = pipeline_texts()
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    bad = [i for i, t in enumerate(texts) if "scumbag" in (t or "")]
    spark.createDataFrame([(i, 1, int(i in bad)) for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return texts, bad


def test_pipeline_equals_plain_stages(spark, tmp_path, monkeypatch):
    import corpus_pipeline
    from tokenizers import Tokenizer

    texts, bad = pipeline_tables(spark, tmp_path)
    left = {i: t for i, t in enumerate(texts) if i not in bad and "$cumb@g" not in (t or "") and "s c u m b a g" not in (t or "")}
    left = {i: t for i, t in left.items() if plain_kept(t)}
    ids = sorted(left)
    _, comps = brute_components([left[i] for i in ids], 5, 80)
    left = {i: left[i] for k, i in enumerate(ids) if comps[k] == k}
    ids, first, cut = sorted(left), {}, {}
    for i in ids:
        w = words_of(left[i])
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    for i in ids:
        w = words_of(left[i])
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(13)}
        if not gone:
            cut[i] = left[i]
        elif len(gone) < len(w):
            cut[i] = " ".join(x for k, x in enumerate(w) if k not in gone)
    assert len(texts) > len(left) > len(set(left.values()) & set(cut.values())) and len(cut) < len(texts) - 15
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert set(got) == set(cut)
    for i, pieces in got.items():
        tokens, at = [*library.encode(cut[i], add_special_tokens=False).ids, 1], 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            part = tokens[at : at + r["length"]]
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += r["length"]
        assert at == len(tokens)


def test_pipeline_stages_on_awkward_rows(spark, tmp_path):
    """Clashing columns, null ids and texts, repeated rows, a long text; then an empty table."""
    import corpus_pipeline

    texts, _ = pipeline_tables(spark, tmp_path)
    rows = [(i, t, "en", "s", len(t or ""), 0.5, "k", 7, "w", 3, True, 1) for i, t in enumerate(texts)] + [(None, texts[0], None, None, None, None, None, None, None, None, None, None)] * 2
    schema = "doc_id long, text string, lang string, source string, n_chars int, score double, kept string, n_words int, words string, id int, whole boolean, component_id int"
    docs = spark.createDataFrame(rows + rows[:3], schema)
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, docs.limit(0)):
            out = stage(spark, given, str(tmp_path))
            n = out.count()
            assert n == 0 if given is not docs else n > 0
            if name != "packing":
                assert out.columns == docs.columns and out.dtypes == docs.dtypes
                assert n <= docs.count()


def test_stored_tables_are_removed(spark):
    from tideline.sources import shared

    with shared.scratch(spark) as kept:
        a = shared.stored(spark.range(3))
        b = shared.stored(spark.range(4))
        kept.append(b)
    assert b.count() == 4
    with pytest.raises(Exception, match="exist"):
        spark.read.parquet(a.inputFiles()[0]).count()
