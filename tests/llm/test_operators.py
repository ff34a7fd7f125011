"""Each operator against brute force on small, awkward tables: nulls, blanks, long texts, ties, repeats, clashing names."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from polyzona.llm import components, mixing, quality, queries, sharding, simhash, suffix_dedup, tiling, token_counts, token_files, toxicity
from polyzona.llm.common import Scratch
from polyzona.llm.substring_dedup import dedup_substrings

WORD = re.compile("[^\x20\x09-\x0d]+")
BASE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from old oaks near a cold clear stream at dusk"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30000))
    out = [
        (0, BASE, "en", "b", 1), (1, BASE, "en", "a", 1), (2, "start " + BASE + " end", "en", "a", 1), (3, BASE.upper(), "en", "ä", 1),
        (4, None, "en", "a", None), (5, "", None, None, 0), (6, " \n\t ", "de", "b", 1), (7, long, "en", "a", 1), (8, "one two", "de", "b", 1),
        (9, "a b c d e " * 200, "fr", "c", 1), (10, "é ü 你好 ñ x y z" * 3, "fr", "c", 1), (11, long[:5000] + " tail", "en", None, 1),
        (12, BASE + "\n" + BASE, "en", "b", 1), (13, "line one here\nline one here\n\nline one here\nother", "en", "b", 1), (14, "### $$$ %%% " * 20, "en", "b", 1),
        (None, BASE, "en", "a", 1), (None, "lonely text of its own", "en", "a", 1), (15, BASE, "en", "b", 1), (15, BASE, "en", "b", 1), (16, "x" * 900, "en", "b", 1),
    ]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(df):
    return Counter(tuple(r) for r in df.collect())


# ---------------------------------------------------------------- 2


def brute_substrings(table, n):
    first = {}
    for d, t, *_ in table:
        w = WORD.findall(t or "")
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            if d is not None:
                first[k] = min(first.get(k, d), d)
    out = Counter()
    for d, t, *_ in table:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if d is not None and first[tuple(w[i : i + n])] < d:
                gone[i : i + n] = [True] * n
        left = " ".join(x for x, g in zip(w, gone) if not g)
        out[d, len(w), sum(gone), hashlib.sha256(left.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("n", [2, 5, 13])
def test_substrings(docs, n):
    got = dedup_substrings(docs, n).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert bag(got) == brute_substrings(rows(), n)


def test_substrings_texts_and_empty(docs, empty):
    kept = {r.doc_id: r.kept for r in dedup_substrings(docs.where("doc_id < 3"), 5, texts=True).collect()}
    assert kept == {0: BASE, 1: "", 2: "start end"}
    assert dedup_substrings(empty).count() == 0


# ---------------------------------------------------------------- 3


def brute_counts(t):
    t = t or ""
    w = WORD.findall(t)
    win = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {i + j for i in range(len(w) - 4) if win[tuple(w[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(map(t.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(cover)


def test_quality_counts(docs):
    got = quality.judge_quality(docs)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    expect = Counter((d, *brute_counts(t)) for d, t, *_ in rows())
    assert bag(got.select("doc_id", *names)) == expect
    for r in got.collect():
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_quality_learns_fences(spark):
    table = [(i, " ".join(f"word{(i * 7 + k * k) % 5003}" for k in range(60)), "en", "s", 1) for i in range(400)]
    table += [(1000 + i, " ".join(f"odd{i}{k}###" for k in range(60)), "en", "s", 1) for i in range(20)]
    kept = quality.keep_good(spark.createDataFrame(table, SCHEMA).withColumn("_m", F.lit(1)))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(400)) and kept.columns[-1] == "_m"


def test_quality_empty(empty):
    assert quality.judge_quality(empty).count() == 0 and quality.keep_good(empty).count() == 0


def test_sketches_merge(spark):
    table = [(i, "x" * (1 + i % 50) + " " + " ".join(f"v{i}{k}" for k in range(12)), "en", f"s{i % 2}", 1) for i in range(500)]
    m = quality.measures(spark.createDataFrame(table, SCHEMA))
    whole = quality.sketches(m.withColumn("source", F.lit("one"))).groupBy("metric", "bucket").agg(F.sum("n"))
    parts = quality.sketches(m).groupBy("metric", "bucket").agg(F.sum("n"))
    assert bag(whole) == bag(parts)


# ---------------------------------------------------------------- 4


def brute_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * sharding.MULTIPLIER + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_matches_the_published_generator(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *(int(x) for x in np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 300))]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 8, 9, 100):
        got = {r.k: r.s for r in df.select("k", sharding.jump_shard(F.col("k"), n).alias("s")).collect()}
        assert got == {k: brute_jump(k % (1 << 64), n) for k in keys}


def test_shards(docs, empty):
    got = sharding.assign_shards(docs.withColumn("slot", F.lit(5))).collect()
    assert len(got) == len(rows())
    for r in got:
        raw = (r.text or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 1, zlib.crc32(raw)) and r.grown_shard in (r.shard, 8)
    slots = Counter((r.shard, r.slot) for r in got)
    sizes = Counter(r.shard for r in got)
    assert set(slots) == {(s, i) for s, n in sizes.items() for i in range(n)} and set(slots.values()) == {1}
    by_id = {}
    for r in got:
        assert by_id.setdefault(r.doc_id, r.shard) == r.shard
    assert sharding.assign_shards(empty).count() == 0


# ---------------------------------------------------------------- 5


def brute_bytes(table, n):
    c = Counter()
    for _, t, *_ in table:
        b = (t or "").encode()
        c.update(b[i : i + n] for i in range(len(b) - n + 1))
    out = Counter()
    for d, t, *_ in table:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if c[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        left = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()] += 1
    return out


@pytest.mark.parametrize("triples", [True, False])
def test_bytes(spark, empty, triples):
    rng = np.random.default_rng(5)
    noise = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    a, b = noise(700), noise(420)
    table = [(d, t) for d, t, *_ in rows()]
    table += [(20, a), (21, noise(50) + a[100:650] + noise(80)), (22, b + noise(9) + b), (23, "ab" * 700), (24, a[:399]), (25, "é" * 300), (26, noise(2000)), (27, noise(30) + b)]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    got = suffix_dedup.dedup_bytes(df, triples=triples)
    assert bag(got.drop("n_passage")) == brute_bytes(table, 400)
    # Whoever has a repeated string of 285 bytes has bytes under names; whoever has none of 158 has not.
    near = Counter((r.doc_id, r.n_bytes, r.n_passage > 0) for r in got.collect())
    for n, has in ((285, True), (158, False)):
        for k, c in brute_bytes(table, n).items():
            assert (k[2] > 0) != has or near[k[0], k[1], has] >= c
    assert suffix_dedup.dedup_bytes(empty, triples=triples).count() == 0


@pytest.mark.parametrize("triples", [True, False])
@pytest.mark.parametrize("n", [160, 250])
def test_bytes_other_lengths(spark, n, triples):
    rng = np.random.default_rng(n)
    pool = [bytes(rng.integers(97, 100, 180).astype(np.uint8)).decode() for _ in range(4)]
    table = [(i, "".join(pool[k] for k in rng.integers(0, 4, 4)) + str(i)) for i in range(30)]
    assert bag(suffix_dedup.dedup_bytes(spark.createDataFrame(table, "doc_id long, text string"), n, passage=160, triples=triples).drop("n_passage")) == brute_bytes(table, n)


def test_bytes_of_a_corpus(spark, data):
    """All of sf0.01 against brute force."""
    docs = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text")
    got = suffix_dedup.dedup_bytes(docs)
    assert bag(got.drop("n_passage")) == brute_bytes([tuple(r) for r in docs.collect()], 400)


# ---------------------------------------------------------------- 6


def test_tiling_finds_moved_parts():
    t = lambda s: tiling.tokens(s.encode())
    item = t("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu")
    doc = t("x y eta theta iota kappa lambda mu z z alpha beta gamma delta epsilon zeta q")
    tiles = tiling.greedy_tiles(item, doc, 4)
    assert sorted(tiles) == [(0, 10, 6), (6, 2, 6)]
    assert tiling.greedy_tiles(item, t("alpha beta gamma nothing else"), 4) == []
    same = t("a b " * 8)
    assert sum(n for _, _, n in tiling.greedy_tiles(same, same, 4)) == 16


def brute_cover(item, doc, tile):
    """Greedy tiles by trying all pairs of places."""
    fi, fd, total = [True] * len(item), [True] * len(doc), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and fi[i + n] and fd[d + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, d)
        n, i, d = best
        if n < tile:
            return total
        total += n
        fi[i : i + n] = fd[d : d + n] = [False] * n


def test_tiling_covers_as_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(40):
        item, doc = rng.integers(0, 5, 20).astype(np.uint64), rng.integers(0, 5, 40).astype(np.uint64)
        got = sum(n for _, _, n in tiling.greedy_tiles(item, doc, 4))
        assert got == brute_cover(item.tolist(), doc.tolist(), 4)


def test_contamination(spark, docs, empty):
    items = spark.createDataFrame([(1, BASE), (2, "words that no document has at all in any order whatever"), (3, None), (4, ""), (5, "one two")], "item_id long, text string")
    moved = " ".join(BASE.split()[12:] + ["..."] + BASE.split()[:12])
    more = docs.unionByName(spark.createDataFrame([(50, moved, "en", "a", 1), (51, BASE.replace("fox", "cat"), "en", "a", 1), (52, BASE[:40], "en", "a", 1)], SCHEMA))
    got = {(r.doc_id, r.item_id) for r in tiling.find_contaminated(more, items, block_bytes=60).collect()}
    # Item 5 is too short for tiles: document 8 has it whole.
    assert got == {(d, 1) for d in (0, 1, 2, 3, 12, 15, None, 50, 51)} | {(8, 5)}
    kept = tiling.drop_contaminated(more.withColumn("item_id", F.lit(1)), items)
    assert sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 7, 9, 10, 11, 13, 14, 16, 52]
    assert tiling.find_contaminated(empty, items).count() == 0 and tiling.find_contaminated(docs, items.limit(0)).count() == 0


# ---------------------------------------------------------------- 7


@pytest.mark.parametrize("ids", [[], [5], [7] * 1000, list(range(3000)), [0, 2**32 - 1] * 700, [3] * 511 + [90000]])
def test_blocks_round_trip(ids):
    a = np.array(ids, np.uint32)
    names, sizes, back = token_files.decode_segment(token_files.encode_segment([4, None], [len(ids), 0], a))
    assert names == [4, None] and sizes.tolist() == [len(ids), 0] and (back == a).all()


def test_blocks_use_exceptions():
    rng = np.random.default_rng(7)
    a = rng.integers(100, 164, 51200).astype(np.uint32)
    a[::100] = 48000
    starts, raw = token_files.encode_ids(a)
    assert len(raw) < len(a) * 1.2 and (token_files.decode_ids(raw, starts, len(a)) == a).all()
    one = token_files.decode_ids(raw[starts[3] : starts[4]], [0, starts[4] - starts[3]], 512)
    assert (one == a[3 * 512 : 4 * 512]).all()


def test_token_files(spark, docs, empty):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    file = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(file)
    odd = [(60, "Don't — “naïve” THEY'LL 42nd <|endoftext|>x <|STARTOFTEXT|> \x1ca's ok'", "en", "a", 1), (61, "ΣΑΣ ΟΔΟΣ É é İ", "en", "a", 1)]
    more = docs.unionByName(spark.createDataFrame(odd, SCHEMA)).where("doc_id IS NULL OR doc_id <> 7")
    path = Scratch(spark).root + "/t"
    token_files.write_tokens(more, path, file, end_id=1, segment_ids=200)
    got = sorted((r.start, r.n_tokens, r.ids_crc32, bytes(r.ids), r.doc_id) for r in token_files.read_tokens(spark, path).collect())
    expect = Counter()
    for d, t, *_ in [r for r in rows() if r[0] != 7] + odd:
        expect[d, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()] += 1
    assert Counter((d, b) for _, _, _, b, d in got) == expect
    at = 0
    for start, n, crc, raw, _ in got:
        assert (start, n, crc) == (at, len(raw) // 4, zlib.crc32(raw))
        at += n
    ids = [d if d is not None else -1 for *_, d in got]
    assert ids == sorted(ids)
    token_files.write_tokens(empty, path + "2", file, end_id=1)
    assert token_files.read_tokens(spark, path + "2").count() == 0


@pytest.mark.parametrize("text", ["one <|endoftext|> two", "one <|endoftext|>. two", "ends <|endoftext|>", "<|startoftext|> a", "x<|endoftext|>, <|other|>!"])
def test_special_tokens_are_encoded_whole(text):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    file = P.path("word_bpe_49k.json")
    got = np.frombuffer(token_files.WordEncoder(file, 1).encode([text.encode()])[0], "<u4")
    assert got.tolist() == [*Tokenizer.from_file(file).encode(text, add_special_tokens=False).ids, 1]


class Counting:
    """A tokenizer that counts the texts it gets; the model alone stands beside it."""

    def __init__(self, tokenizer):
        self.tokenizer, self.model, self.texts = tokenizer, tokenizer.model, 0

    def encode_batch_fast(self, texts, **more):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **more)


def test_words_of_latin_letters_go_to_the_model_alone():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    file = P.path("word_bpe_49k.json")
    tok, words = Tokenizer.from_file(file), token_files.WordEncoder(file, 1, room=50)
    words.tokenizer = Counting(words.tokenizer)
    rng = np.random.default_rng(11)
    letters = [chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)] + list("abcdefghijklmnopqrstuvwxyzAEIOU")
    made = [*letters, *("".join(rng.choice(letters, rng.integers(1, 14))) for _ in range(400))]
    ids = lambda t: [*tok.encode(t, add_special_tokens=False).ids, 1]
    for text in (" ".join(made), " ".join(f"{w}a" for w in made)):
        assert np.frombuffer(words.encode([text.encode()])[0], "<u4").tolist() == ids(text)
    assert words.tokenizer.texts == 0 and len(words.words) <= 50
    odd = ["\xd7", "a\xf7b", "é\u0301", "e\u0301", "\xb5m", "ÿ\u0178", "\u0130i", "ﬁn", "été.", "a.b", "x's", "x's,", "x'", "x9.", "9x,", "ü's", "Ünï***", "\x00a", "a\x00", "a\x1c", "<|startoftext|>.", "É<|endoftext|>É,"]
    for text in (*odd, " ".join(odd), " ".join(w + "," for w in odd)):
        assert np.frombuffer(words.encode([text.encode()])[0], "<u4").tolist() == ids(text), text


# ---------------------------------------------------------------- 9


def test_targets(spark):
    def targets(sizes):
        got = mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()
        return sorted(got, key=lambda r: (r.source is None, r.source or ""))

    got = targets([("b", 100), (None, 10), ("a", 1000), ("c", 1)])
    assert [g.source for g in got] == ["a", "b", "c", None]
    assert abs(sum(g.target for g in got) - 1111) < 1e-6 and all(g.target <= 3 * g.source_size + 1e-9 for g in got)
    assert targets([]) == [] and targets([("a", 0)])[0].target == 0
    # Brute force: give by weight, cap, and give again what is left over.
    sizes = [(f"s{i:02d}", (i * 37) % 101 * 10 ** (i % 4)) for i in range(30)]
    left, open_, want = float(sum(n for _, n in sizes)), list(range(30)), {}
    while open_:
        full = sum(i % 3 + 1 for i in open_)
        over = [i for i in open_ if left * (i % 3 + 1) / full >= 3 * sizes[i][1]]
        if not over:
            want |= {i: left * (i % 3 + 1) / full for i in open_}
            break
        for i in over:
            want[i] = 3.0 * sizes[i][1]
        left -= sum(want[i] for i in over)
        open_ = [i for i in open_ if i not in over]
    assert all(abs(r.target - want[i]) < 1e-6 * max(1, want[i]) for i, r in enumerate(targets(sizes)))


def test_mix(spark, docs, empty):
    table = [(i, " ".join(["w"] * (1 + i % 9)), "en", "abc"[i % 7 % 3] if i % 11 else None, 1) for i in range(2000)]
    df = spark.createDataFrame(table, SCHEMA).withColumn("taken", F.lit("x"))
    got = mixing.mix(df).collect()
    assert len(got) == 2000
    by = {}
    for r in got:
        assert r["size"] == 1 + r.doc_id % 9 and r.taken % r["size"] == 0 and r.taken <= 3 * r["size"]
        t = by.setdefault(r.source, [r.target, 0])
        t[1] += r.taken
    assert all(abs(target - taken) <= 10 for target, taken in by.values())
    want = Counter((r.doc_id, r.taken) for r in got)
    assert bag(mixing.mix(df).select("doc_id", "taken")) == want and bag(mixing.mix(df, aim=16).select("doc_id", "taken")) == want
    drawn = mixing.draw(df)
    assert drawn.count() == sum(r.taken // r["size"] for r in got) and drawn.columns == df.columns
    assert mixing.mix(docs).count() == len(rows()) and mixing.mix(empty).count() == 0 and mixing.draw(empty).count() == 0


# ---------------------------------------------------------------- 10


def brute_print(t, width=3):
    w = WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    sh = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(items, near):
    up = list(range(len(items)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if near(items[i], items[j]):
                up[root(i)] = root(j)
    return [root(i) for i in range(len(items))]


def test_near_duplicates(spark, docs, empty):
    texts = [(100 + i, " ".join(BASE.split()[: 12 + i])) for i in range(11)] + [(200 + i, BASE + " x" * i) for i in range(5)]
    table = [(d, t) for d, t, *_ in rows()] + texts
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(table, "doc_id long, text string"), node=2).collect())
    prints = [brute_print(t) for _, t in table]
    roots = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for (d, _), r in zip(table, roots):
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    assert got == Counter((d, f"{p:016x}", least[r]) for (d, _), p, r in zip(table, prints, roots))
    assert simhash.near_duplicates(empty).count() == 0


def test_trie_finds_all_pairs():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64))
    a, b = np.sort(base), np.sort(np.concatenate([near, rng.integers(0, 1 << 63, 500, dtype=np.uint64)]))
    for budget in (0, 1, 2, 3):
        got = {(int(x), int(y)) for xs, ys in simhash.trie_links(a, b, budget, leaf=4) for x, y in zip(xs, ys)}
        assert got == {(i, j) for i in range(len(a)) for j in range(len(b)) if (int(a[i]) ^ int(b[j])).bit_count() <= budget}


def test_crowded_nodes_are_walked_down(spark):
    rng = np.random.default_rng(10)
    base = int(rng.integers(0, 1 << 62))
    prints = sorted({base ^ sum(1 << int(b) for b in rng.integers(0, 64, int(k))) for k in rng.integers(0, 4, 400)} | {int(x) for x in rng.integers(0, 1 << 62, 200)})
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in prints]
    scratch = Scratch(spark)
    found = scratch.write(simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), scratch, 2, node=4))
    roots = {r.node: r.root for r in components.connected_components(found, scratch).collect()}
    mine = [roots.get(s, s) for s in signed]
    expect = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    assert len({(m, e) for m, e in zip(mine, expect)}) == len(set(mine)) == len(set(expect))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{200 + i: 100 for i in range(50)}, 100: 100}


def test_keep_one(docs):
    kept = simhash.keep_one(docs.withColumn("fp", F.lit("x"))).collect()
    found = Counter((r.doc_id, r.text) for r in kept)
    assert found[0, BASE] == 1 and found[1, BASE] == found[15, BASE] == found[3, BASE.upper()] == 0
    assert sum(found.values()) == len({c for c in _classes()}) and "fp" in kept[0].asDict()


def _classes():
    prints = [brute_print(t) for _, t, *_ in rows()]
    return brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 2)


# ---------------------------------------------------------------- 1


def test_ledger(spark):
    ledger = token_counts.Ledger(spark, Scratch(spark).root + "/ledger")
    cols = "doc_id long, source string, lang string, version string, op string, n_tokens long, at long"
    batch = lambda *r: spark.createDataFrame(list(r), cols)
    first = batch((1, "a", "en", "v1", "insert", 10, 0), (2, "a", "en", "v1", "insert", 5, 0), (3, None, None, "v1", "insert", None, 0), (2, "a", "en", "v1", "insert", 7, 1), (None, "b", "en", "v1", "insert", 4, None))
    assert ledger.commit("b1", first) and not ledger.commit("b1", first)
    assert bag(ledger.totals()) == Counter({("a", "en", "v1", 2, 17): 1, (None, None, "v1", 1, 0): 1, ("b", "en", "v1", 1, 4): 1})
    second = batch((1, "a", "en", "v1", "delete", 0, 0), (2, "c", "de", "v1", "revise", 9, 0), (9, "a", "en", "v1", "delete", 0, 0), (1, "a", "en", "v2", "insert", 11, 0))
    assert ledger.commit("b2", second)
    assert bag(ledger.totals()) == Counter({("c", "de", "v1", 1, 9): 1, (None, None, "v1", 1, 0): 1, ("b", "en", "v1", 1, 4): 1, ("a", "en", "v2", 1, 11): 1})
    assert ledger.commit("b3", batch((1, "a", "en", "v1", "insert", 3, 0)))
    alive = ledger.state().where("alive").groupBy("source", "lang", "version").agg(F.count("*"), F.sum("n_tokens"))
    assert bag(alive) == bag(ledger.totals())
    assert ledger.commit("b4", batch().limit(0)) and bag(alive) == bag(ledger.totals())
    with pytest.raises(Exception, match="op must be"):
        ledger.commit("b5", batch((1, "a", "en", "v1", "drop", 3, 0)))
    assert ledger.batches() == ["b1", "b2", "b3", "b4"]
    before = bag(ledger.totals()), bag(ledger.state())
    ledger.compact()
    assert len(ledger._folders()) == 1 and (bag(ledger.totals()), bag(ledger.state())) == before


def test_ledger_of_two_writers(spark):
    """A writer whose number is taken starts again from what the other one left; random batches against a dictionary."""
    path, rng = Scratch(spark).root + "/ledger", np.random.default_rng(1)
    cols = "doc_id long, source string, lang string, version string, op string, n_tokens long, at long"
    a, b = token_counts.Ledger(spark, path, compact_every=3), token_counts.Ledger(spark, path, compact_every=3)
    held = {}
    for k in range(7):
        rows = [(int(d), "s%d" % rng.integers(3), "en", "v", ["insert", "delete", "revise"][rng.integers(3)], int(rng.integers(50)), 0) for d in rng.permutation(12)[:6]]
        if k == 4:  # b takes the number that a has prepared for
            prepare = a._prepare

            def late(one, seq, folder):
                prepare(one, seq, folder)
                if a._prepare is not prepare:
                    a._prepare = prepare
                    assert b.commit("between", spark.createDataFrame([(1, "z", "en", "v", "insert", 1000, 0)], cols))
                    held[1] = ("z", 1000)

            a._prepare = late
        assert (a if k % 2 == 0 else b).commit(f"n{k}", spark.createDataFrame(rows, cols))
        for d, s, _, _, op, n, _ in rows:
            if op == "delete":
                held.pop(d, None)
            else:
                held[d] = (s, n)
    want = Counter()
    for s, n in held.values():
        want[s, "en", "v"] += n
    assert {tuple(r)[:3]: r.n_tokens for r in a.totals().collect()} == dict(want) and sum(r.n_docs for r in a.totals().collect()) == len(held)


def test_op1_as_brute_force(spark, data):
    P = pytest.importorskip("public_tokenizers")
    enc = token_counts._encoder(P.path("byte_bpe_50k.tiktoken"))
    toxic = {r.doc_id for r in spark.read.parquet(f"{data}/labels.parquet").collect() if r.toxic == 1}
    want = Counter()
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        if r.doc_id not in toxic:
            want[r.source, r.lang, "docs"] += 1
            want[r.source, r.lang, "tokens"] += len(enc.encode_ordinary(r.text or ""))
    got = Counter()
    for r in queries.op1_token_counts(spark, data).collect():
        got[r.source, r.lang, "docs"], got[r.source, r.lang, "tokens"] = r.n_docs, r.n_tokens
    assert +got == +want


def test_count_tokens(docs, empty):
    P = pytest.importorskip("public_tokenizers")
    file = P.path("byte_bpe_50k.tiktoken")
    enc = token_counts._encoder(file)
    got = token_counts.count_tokens(docs.withColumn("n_tokens", F.lit(1)), file)
    assert bag(got.select("doc_id", "n_tokens")) == Counter((d, len(enc.encode_ordinary(t)) if t else 0) for d, t, *_ in rows())
    assert token_counts.count_tokens(empty, file).count() == 0


# ---------------------------------------------------------------- 8


def test_fit_is_the_optimum():
    rng = np.random.default_rng(8)
    x, y = (rng.random((300, 12)) < 0.3).astype(float), (rng.random(300) < 0.4).astype(float)
    w, whole = toxicity._fit(x, y), np.concatenate([np.ones((300, 1)), x], axis=1)
    ridge = np.full(13, 1.0)
    ridge[0] = 1e-6
    slope = lambda v: whole.T @ (y - 1 / (1 + np.exp(-whole @ v))) - ridge * v
    assert np.abs(slope(w)).max() < 1e-4
    # Plain ascent along the slope ends at the same place.
    v = np.zeros(13)
    for _ in range(20000):
        v += 0.005 * slope(v)
    assert np.abs(v - w).max() < 1e-3


def test_chain_learns_from_predictions_out_of_fold():
    rng = np.random.default_rng(9)
    words = [np.unique(rng.integers(1, 30, 8)).astype(np.uint64) for _ in range(200)]
    y = np.array([[float(5 in w), float(5 in w or 7 in w)] for w in words])
    folds = np.arange(200) % 5
    chain = toxicity.fit_chain(y, words, folds, features=10)
    x = np.array([[float(n in w) for n in chain.words] for w in words])
    out = np.zeros(200)
    for f in range(5):
        w = toxicity._fit(x[folds != f], y[folds != f, 0])
        out[folds == f] = w[0] + x[folds == f] @ w[1:]
    second = toxicity._fit(np.concatenate([x, out[:, None]], axis=1), y[:, 1])
    start, weights, earlier = chain.models[1]
    assert abs(start - second[0]) < 1e-9 and np.allclose(weights, second[1:-1]) and np.allclose(earlier, second[-1:])


def test_scores_as_brute_force(spark, docs):
    t = lambda s: tiling.tokens(s.encode())
    names = np.unique(np.concatenate([t("fox"), t("dog"), t("the"), t("word")]))
    chain = toxicity.Chain(names, [(-0.5, np.array([1.0, -2.0, 0.5, 0.25]), np.zeros(0)), (0.1, np.array([0.3, 0.2, -1.0, 2.0]), np.array([0.7]))])
    want = Counter()
    for d, text, *_ in rows():
        has = np.isin(names, tiling.tokens((text or "").encode()))
        first = -0.5 + has @ chain.models[0][1]
        second = 0.1 + has @ chain.models[1][1] + 0.7 * first
        want[d, round(1 / (1 + np.exp(-first)), 9), round(1 / (1 + np.exp(-second)), 9)] += 1
    clash = docs.withColumns({"p_toxic": F.lit("x"), "toxic": F.lit(1), "y": F.lit(2)})
    got = Counter((r.doc_id, round(r.p_low_quality, 9), round(r.p_toxic, 9)) for r in toxicity.score_toxicity(clash, chain).collect())
    assert got == want
    labels = spark.createDataFrame([(0, 1, 0), (0, 1, 0), (1, 0, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    assert len(toxicity.train_toxicity(docs.union(docs).union(docs), labels, sample=2).models) == 2


def test_toxicity_on_held_out_rows(spark, data):
    docs, labels = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.1')}/documents.parquet"), spark.read.parquet(f"{data.replace('sf0.001', 'sf0.1')}/labels.parquet")
    held = F.xxhash64("doc_id", F.lit(5)) % 4 == 0
    chain = toxicity.train_toxicity(docs, labels.where(~held))
    got = toxicity.score_toxicity(docs, chain).withColumnRenamed("toxic", "hit").join(labels.where(held), "doc_id").collect()
    right = sum(r.hit == bool(r.toxic) for r in got) / len(got)
    caught = [r.hit for r in got if r.toxic]
    false = [r.hit for r in got if not r.toxic]
    assert right > 0.93 and sum(caught) / len(caught) > 0.6 and sum(false) / len(false) < 0.03


def test_toxicity_edges(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    blank = toxicity.train_toxicity(docs, none)
    assert {r.p_toxic for r in toxicity.score_toxicity(docs, blank).collect()} == {0.5}
    one = spark.createDataFrame([(0, 1, 0), (3, 1, 0), (4, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert all(r.p_toxic < 0.01 for r in toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, one)).collect())
    assert toxicity.score_toxicity(empty, blank).count() == 0
