"""Operators 1, 2 and 4: exact round trips, and other libraries' counts."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models

from tessera.llm import bitplanes, packing, viterbi
from tessera.llm.common import crc32_join, new_path, span_tokenizer


def whole(name, texts):
    t = Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch_fast([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


ODD = ["a", "B", "é", "É", " ", "  ", "\n", ".", ",", "'", "'s", "1", "½", "́", "̱", "H", "Σ", "İ", "ǅ", "<", "\x01", "\x1d", "\xa0", "ß", "漢", "|", "<|endoftext|>"]


@pytest.mark.parametrize(("kind", "name", "width"), [("byte", "byte_bpe_50k.json", 2), ("word", "word_bpe_49k.json", 4)])
def test_spans_encode_as_whole_texts(kind, name, width):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 14))) for _ in range(4000)]
    tok = span_tokenizer(P.path(name), kind, width)
    assert [np.frombuffer(b, tok.dtype).tolist() for b in tok.encode_all(texts)] == whole(name, texts)


def test_long_text_encodes_in_slices():
    text = ("some words, and  more\n" * 40_000)[: 1 << 19] + " " * 5 + "end"
    tok = span_tokenizer(P.path("byte_bpe_50k.json"), "byte", 2)
    assert np.frombuffer(tok.encode(text), "<u2").tolist() == whole("byte_bpe_50k.json", [text])[0]


@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.sampled_from(["bit", "byte"]))
@settings(max_examples=60, deadline=None)
def test_planes_round_trip(ids, mode):
    assert bitplanes.from_planes(bitplanes.to_planes(np.array(ids, "u4"), mode), len(ids), mode).tolist() == ids


@given(st.binary(max_size=60), st.binary(max_size=60))
def test_crc_join(a, b):
    assert crc32_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@pytest.mark.parametrize("mode", ["bit", "byte"])
def test_token_container(spark, corpus, mode):
    df, rows = corpus
    path = new_path(spark, "t")
    bitplanes.write_tokens(df, path, P.path("byte_bpe_50k.json"), 2, block_ids=256, shard_docs=40, mode=mode)
    got = sorted(bitplanes.read_tokens(spark, path).collect(), key=lambda r: r.start)
    docs = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [d[0] for d in docs]
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    ids = Counter((d[0], tuple([*x, 2])) for d, x in zip(docs, whole("byte_bpe_50k.json", [d[1] for d in docs]), strict=True))
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == ids
    assert all(r.ids_crc32 == zlib.crc32(r.ids) and r.n_tokens == len(r.ids) // 4 for r in got)


def test_token_container_empty(spark, empty):
    path = new_path(spark, "t")
    bitplanes.write_tokens(empty, path, P.path("byte_bpe_50k.json"), 2)
    assert bitplanes.read_tokens(spark, path).count() == 0


def pack_by_bins(lengths, capacity):
    """Best-two-fit, bin after bin, with nothing counted together."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        b, gap = [], capacity
        for x in list(left):
            if x <= gap:
                b.append(x)
                gap -= x
                left.remove(x)
        if gap and len(b) > 1:
            small = b[-1]
            pairs = [(x + y, x, y) for i, x in enumerate(left) for y in left[i + 1 :] if small < x + y <= small + gap]
            if pairs:
                _, x, y = max(pairs)
                b[-1:] = [x, y]
                left.remove(x)
                left.remove(y)
                left = sorted([*left, small], reverse=True)
        bins.append(tuple(sorted(b)))
    return Counter(bins)


@given(st.lists(st.integers(1, 40), max_size=80))
@settings(max_examples=150, deadline=None)
def test_plan_is_best_two_fit(lengths):
    plan = packing.plan_bins(Counter(lengths), 40)
    assert Counter({k: v for k, v in _bins(plan).items()}) == pack_by_bins(lengths, 40)


def _bins(plan):
    out = Counter()
    for b, times in plan:
        out[tuple(sorted(n for n, c in b.items() for _ in range(c)))] += times
    return out


def test_packing(spark, corpus):
    df, rows = corpus
    pieces, places = packing.pack(df, P.path("word_bpe_49k.json"), 0, capacity=64)
    got = places.collect()
    want = Counter()
    for (doc, _, _), ids in zip(rows, whole("word_bpe_49k.json", [r[1] for r in rows]), strict=True):
        ids = [*ids, 0]
        want.update((doc, k // 64, k, len(ids[k : k + 64]), crc(ids[k : k + 64])) for k in range(0, len(ids), 64))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        s.sort()
        assert [o for o, _ in s] == np.cumsum([0, *(n for _, n in s)])[:-1].tolist() and sum(n for _, n in s) <= 64
    assert len(seqs) <= 1.05 * sum(r.length for r in got) / 64 + 1
    made = packing.sequences(pieces, places).collect()
    assert len(made) == len(seqs) and sum(len(m.ids) for m in made) == 4 * sum(r.length for r in got)


def test_packing_empty(empty):
    _, places = packing.pack(empty, P.path("word_bpe_49k.json"), 0)
    assert places.count() == 0


def test_viterbi_is_the_tokenizer(spark, corpus):
    df, rows = corpus
    path = P.path("piece_bpe_32k.model")
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    model = Tokenizer(models.Unigram([(m.id_to_piece(i), m.get_score(i)) for i in range(m.vocab_size())], 0, True))
    want = Counter((d, len(model.encode((" " + t).replace(" ", "▁"), add_special_tokens=False).ids) if t else 0) for d, t, _ in rows)
    assert Counter((r.doc_id, r.n_tokens) for r in viterbi.count_tokens(df, path).collect()) == want


@given(st.text("abé▁ ", max_size=14), st.lists(st.tuples(st.text("abé", min_size=1, max_size=3), st.integers(-4, -1)), max_size=8), st.booleans(), st.booleans())
@settings(max_examples=300, deadline=None)
def test_viterbi_ties(text, pieces, byte_fallback, whole_scores):
    """Ties and unknown characters, against the public library on small vocabularies."""
    vocab = dict(pieces) | {"▁" + p: s for p, s in pieces[:2]}
    vocab = [(p, float(s) if whole_scores else s - 0.5) for p, s in vocab.items()]
    if not vocab:
        return
    c = viterbi.Counter(vocab, byte_fallback)
    extra = [(f"<0x{b:02X}>", -100.0) for b in range(256)] if byte_fallback else []
    low = min(s for _, s in vocab)
    lib = Tokenizer(models.Unigram([("<unk>", 0.0), *vocab, *([(p, low) for p, _ in extra])], 0, byte_fallback))
    t = text.replace("▁", " ")
    want = len(lib.encode((" " + t).replace(" ", "▁"), add_special_tokens=False).ids) if t else 0
    assert c.measure(t)[0] == (want if byte_fallback else c.solve((" " + t).replace(" ", "▁"))[0] if t else 0)
    if not byte_fallback and t:
        assert c.solve((" " + t).replace(" ", "▁"))[0] == want


def test_counts_empty(empty):
    assert viterbi.count_tokens(empty, P.path("piece_bpe_32k.model")).count() == 0
