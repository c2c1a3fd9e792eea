import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

tiktoken = pytest.importorskip("tiktoken")
tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")

from scriptloom.llm import byte_bpe, common, packing, prefix_bpe, token_counts  # noqa: E402

TEXT = st.text("ab \n\t1é中'<|>.́ sT", max_size=60)


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.encoder("byte_bpe_50k.tiktoken", None, None)


@pytest.fixture(scope="module")
def reference(coder):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(coder.tokens)}, special_tokens={})


def test_bpe_equals_library(coder, reference):
    @settings(max_examples=200, deadline=None)
    @given(TEXT)
    def check(text):
        ids = coder.encode(text)
        assert ids == reference.encode_ordinary(text) and coder.decode(ids) == text.encode()

    check()


def test_perfect_hash_is_minimal(coder):
    table = coder.table
    found = table.find(*byte_bpe.joined(coder.tokens))
    assert (found == np.arange(len(coder.tokens))).all() and sorted(table.value.tolist()) == list(range(len(coder.tokens)))
    assert table.find(*byte_bpe.joined([b"no such token at all", b""])).tolist() == [-1, -1]


def test_digests_and_round_trip(docs, corpus, nothing, reference):
    got = {r.doc_id: r for r in byte_bpe.digests(docs).collect()}
    for i, text in corpus:
        ids = reference.encode_ordinary(text or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    decoded = {r.doc_id: bytes(r.decoded) for r in byte_bpe.decode(byte_bpe.encode(docs)).collect()}
    assert decoded == {i: (t or "").encode() for i, t in corpus}
    assert byte_bpe.digests(nothing).collect() == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_equal_library(docs, corpus, nothing, name):
    if name.endswith("model"):
        model = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=P.path(name))
        count = lambda t: len(model.encode(t))
    else:
        model = tokenizers.Tokenizer.from_file(P.path(name))
        count = lambda t: len(model.encode(t, add_special_tokens=False))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, name).collect()}
    assert got == {i: (len((t or "").encode()), n := count(t or ""), n > 1024) for i, t in corpus}
    assert token_counts.count_tokens(nothing, name).collect() == []


def test_safe_parts():
    counter = token_counts.Counter(P.path("byte_bpe_50k.json"))
    model = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))

    @settings(max_examples=200, deadline=None)
    @given(TEXT)
    def check(text):
        assert "".join(token_counts.parts_of(text)) == text
        assert counter.count([text]) == [len(model.encode(text, add_special_tokens=False))]

    check()


def test_safe_parts_of_sentencepiece():
    """Boundaries hold for odd texts, marks for spaces among them; batches are balanced by bytes."""
    model = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    counter = token_counts.Counter(P.path("piece_bpe_32k.model"))
    assert not counter.whole
    rng = random.Random(1)
    texts = ["".join(rng.choice("abé \n\t中\u0301\ufb01<s>/1\u2581 ,.") for _ in range(rng.randint(0, 40))) for _ in range(8000)] + ["a b " * 3000, " ", "", None, "\u2581"]
    assert counter.count(texts) == [len(model.encode(t or "")) for t in texts]
    seen = []
    counter.lengths = lambda texts: seen.append(sum(len(t.encode()) for t in texts)) or [1] * len(texts)
    counter.memo.clear()
    counter.count(["中" * 50_000 + str(i) for i in range(6)])
    assert max(seen) <= token_counts.BATCH_BYTES


#: Special strings, also in other case, and pieces of them.
ODD = st.lists(st.sampled_from(["<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|end", "don't", "A.B,", "x!!", "\u00c9t\u00e9", "e\u0301", "\u0130", "\u4e2d\u6587", "12", "\t", " ", "\n", "\u00a0", "aaaa", "the", "\U0001f642"]), max_size=12).map("".join)


@pytest.fixture(scope="module")
def words():
    model = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return {"packing": packing.WordTokenizer(P.path("word_bpe_49k.json")), "prefixes": prefix_bpe.PrefixTokenizer(P.path("word_bpe_49k.json")), "library": model}


def encoded(ours, texts):
    """Ids of all texts, encoded in one pass."""
    ids, first = ours.encode(*common.text_buffer(pa.array(texts, pa.string())))
    return [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]


@pytest.mark.parametrize("kind", ["packing", "prefixes"])
def test_words_equal_library(words, kind):
    @settings(max_examples=200, deadline=None)
    @given(st.lists(TEXT | ODD, min_size=1, max_size=6))
    def check(texts):
        assert encoded(words[kind], texts) == [e.ids for e in words["library"].encode_batch(texts, add_special_tokens=False)]

    check()


@pytest.mark.parametrize("kind", ["packing", "prefixes"])
def test_random_words_equal_library(words, kind):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab" if i % 2 else "etaoinshrdlu\u00e9") for _ in range(rng.randint(1, 70))) for i in range(3000)] + ["a" * n for n in range(130)] + ["", None, "\u4e2d" * 5000]
    assert encoded(words[kind], texts) == [e.ids for e in words["library"].encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_tokens_stay_whole_and_pairs_hold(words):
    """One word alone and many in step give the same; every word of the vocabulary is one token; neighbours in an encoding may stand side by side."""
    bpe = words["prefixes"].bpe
    ends = [(i, t[:-4]) for t, i in words["library"].get_vocab().items() if t.endswith("</w>")][::7]
    value = {c: b for b, c in enumerate(prefix_bpe.byte_characters())}
    spelled = [bytes(value[c] for c in t) for _, t in ends]
    ids, sizes, order = bpe.encode(spelled)
    assert (sizes == 1).all() and ids.tolist() == [ends[k][0] for k in order.tolist()]
    rng = random.Random(3)
    for _ in range(300):
        word = bytes(rng.choice(b"abcdeinorst") for _ in range(rng.randint(2, 30)))
        alone = bpe.one(word)
        many, _, _ = bpe.encode([word])
        assert alone == many.tolist() and all(bpe._beside(a, b) for a, b in zip(alone, alone[1:], strict=False))


def test_two_merges_for_one_token_are_refused():
    letters = {c: i for i, c in enumerate(prefix_bpe.byte_characters())}
    with pytest.raises(ValueError):
        prefix_bpe.PrefixBPE(letters | {"ab": 256, "bc": 257, "abc": 258}, [("a", "b"), ("b", "c"), ("ab", "c"), ("a", "bc")], "")


def test_vocabulary_without_word_ends():
    letters = {c: i for i, c in enumerate(prefix_bpe.byte_characters())}
    bpe = prefix_bpe.PrefixBPE(letters | {"ab": 256, "cd": 257, "bcd": 258}, [("a", "b"), ("c", "d"), ("b", "cd")], "")
    assert bpe.one(b"abcd") == [256, 257] and bpe.one(b"xbcd") == [letters["x"], 258] and bpe.encode([b"abcd"])[0].tolist() == [256, 257]


def test_prefix_digests_and_round_trip(spark, docs, corpus, nothing, words):
    model = words["library"]
    got = {r.doc_id: r for r in prefix_bpe.digests(docs).collect()}
    for i, text in corpus:
        ids = model.encode(text or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(model.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    decoded = {r.doc_id: r.decoded for r in prefix_bpe.decode(prefix_bpe.encode(docs)).collect()}
    assert decoded == {i: model.decode(model.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for i, t in corpus}
    assert prefix_bpe.digests(nothing).collect() == []


def test_prefix_edges(spark, words):
    """Repeated rows, null ids, columns named like results, special strings, odd ids to decode."""
    rows = [(1, "a <|endoftext|> b", 7, "x"), (1, "a <|endoftext|> b", 7, "x"), (None, "c", 7, "y"), (2, None, None, None), (3, "", 1, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids_sha256 string")
    got = sorted(((r.doc_id, r.n_tokens) for r in prefix_bpe.digests(table).collect()), key=str)
    assert got == [(1, 3), (1, 3), (2, 0), (3, 0), (None, 1)]
    odd = spark.createDataFrame([(1, [320, 49407, -1, 10**6, None]), (2, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in prefix_bpe.decode(odd).collect()} == {1: words["library"].decode([320, 49407], skip_special_tokens=False), 2: ""}


def test_plan_uses_every_piece_once():
    rng = random.Random(2)
    for _ in range(200):
        size = rng.randint(3, 60)
        counts = np.zeros(size + 1, np.int64)
        for _ in range(rng.randint(0, 12)):
            counts[rng.randint(1, size)] += rng.randint(0, 30)
        used = np.zeros(size + 1, np.int64)
        bins = packing.plan(counts, size)
        for times, held in bins:
            assert sum(x * n for x, n in held) <= size
            for x, n in held:
                used[x] += times * n
        assert (used == counts).all()


def test_plan_is_near_the_optimum():
    """Against the least number of bins, by trying all ways, on small instances: exact complements find it nearly always."""

    def least(items, size):
        best = len(items)

        def place(k, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if k == len(items):
                best = len(bins)
                return
            for i in range(len(bins)):
                if bins[i] >= items[k] and bins[i] not in bins[:i]:
                    place(k + 1, [*bins[:i], bins[i] - items[k], *bins[i + 1 :]])
            place(k + 1, [*bins, size - items[k]])

        place(0, [])
        return best

    rng, extra = random.Random(11), []
    for _ in range(150):
        size = rng.randint(8, 40)
        items = sorted((rng.randint(1, size) for _ in range(rng.randint(1, 9))), reverse=True)
        used = sum(times for times, _ in packing.plan(np.bincount(items, minlength=size + 1), size))
        extra.append(used - least(items, size))
    assert min(extra) >= 0 and max(extra) <= 1 and sum(extra) <= 8


def test_repeats_and_clashing_columns(spark, words):
    """Rows that repeat an id or each other, and input columns named like results, in ops 3, 8, 9 and 12."""
    schema = "doc_id long, text string, n_tokens string, piece double, length string, n_bytes string, ids_sha256 int, offset int, start string"
    rows = [(i, t, "x", 1.0, "x", "x", 1, 2, "x") for i, t in [(1, "a b"), (1, "a b"), (1, "other"), (None, "c"), (2, None)]]
    table = spark.createDataFrame(rows, schema).repartition(2)
    for counted in (byte_bpe.digests(table), token_counts.count_tokens(table), prefix_bpe.digests(table)):
        assert sorted(((r.doc_id, r.n_tokens) for r in counted.collect()), key=str) == sorted([(1, 2), (1, 2), (1, 1), (None, 1), (2, 0)], key=str)
    packed = packing.pack(table, 16).collect()
    assert sorted(((r.doc_id, r.piece, r.length) for r in packed), key=str) == sorted([(1, 0, 3), (1, 0, 3), (1, 0, 2), (None, 0, 2), (2, 0, 1)], key=str)
    assert len({r.sequence_id for r in packed}) == 1 and sorted(r.offset for r in packed)[0] == 0


def test_plan_fills_exactly():
    counts = np.zeros(101, np.int64)
    counts[[60, 40, 30, 10, 50, 25, 15]] = [3, 1, 1, 1, 1, 1, 2]
    assert sum(times for times, _ in packing.plan(counts, 100)) == 4


@pytest.mark.parametrize("size", [7, 2048])
def test_pack(docs, corpus, nothing, size):
    model = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {}
    for i, text in corpus:
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(ids), size)):
            part = ids[at : at + size]
            want[i, n] = (at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), part)
    rows = packing.pack(docs, size, with_ids=True).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32, r.ids) for r in rows} == want
    held: dict[int, list] = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in held.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= size
    total = sum(len(x[3]) for x in want.values())
    assert len(held) <= 1.05 * -(-total // size) + 1
    assert packing.pack(nothing, size).collect() == []


def test_slices():
    assert list(common.slices(np.array([5, 1, 1, 9, 1]), 3)) == [(0, 1), (1, 3), (3, 4), (4, 5)]
