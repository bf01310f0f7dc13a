"""Chat formatting, token files and packing against plain Python."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from speechstats.llm import chat, packing, repair
from speechstats.llm.common import scratch_path

from .helpers import documents, words

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["a  b\n c", None, "", "  x", "y  ", "it's 'd x\t y", "café x ́y Ünï, ÀÉ.", "x  y z", "12,5 a1b2 _x_ \\ </s>", "ab " * 3000, words(1, 400), words(1, 400)]


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", "hi <|im_next|> \\ [INST]"), (1, 1, "user", None), (1, 2, "assistant", "<|im_end|>\n\\\\<s>"), (1, 3, "assistant", "é𝄞"),
        (2, None, None, "x"), (2, 0, "assistant", ""), (None, 0, "assistant", "y"), (2, 0, "assistant", ""),
    ]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, turns int")
    out = {r.conv_id: r for r in chat.digest(chat.parse_chats(chat.format_chats(df))).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        learnt = "".join(t for _, role, t in own if role == "assistant")
        assert out[conv].n_turns == len(own)
        assert out[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        assert (out[conv].loss_chars, out[conv].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert out[1].n_blocks == 2
    assert chat.digest(chat.parse_chats(chat.format_chats(df.limit(0)))).count() == 0


def test_token_files(spark):
    rows = [(k * 3 % 11, t) for k, t in enumerate(TEXTS)]
    path = scratch_path(spark, "t")
    repair.write_ids(documents(spark, rows), path, WORD, 2)
    out = repair.read_ids(spark, path).orderBy("start").collect()
    t = Tokenizer.from_file(WORD)
    expect = {}
    for i, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        expect.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got, at = {}, 0
    assert [r.doc_id for r in out] == sorted(i for i, _ in rows)
    for r in out:
        assert r.start == at
        at += r.n_tokens
        got.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expect.items()}
    for row in spark.read.parquet(path).collect():
        shard = repair.Shard(row.asDict())
        ids, ends = shard.all()
        for k in range(len(ends)):
            own = ids[ends[k - 1] if k else 0 : ends[k]]
            assert (shard.document(k) == own).all() and shard.token(k, len(own) - 1) == own[-1] and shard.token(k, len(own) // 2) == own[len(own) // 2]
    empty = scratch_path(spark, "t")
    repair.write_ids(documents(spark, [(1, "a")]).limit(0), empty, WORD, 2)
    assert repair.read_ids(spark, empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), min_size=1, max_size=60), min_size=1, max_size=8))
def test_repair_is_lossless(docs):
    ids, ends = np.array(sum(docs, []), np.uint16), np.cumsum([len(x) for x in docs])
    symbols, symbol_ends, rules, lengths = repair.compress(ids, ends)
    shard = repair.Shard({"doc_ids": None, "symbol_ends": symbol_ends.astype("<u4").tobytes(), "symbols": symbols.tobytes(), "rules": rules.tobytes(), "lengths": lengths.astype("<u4").tobytes()})
    back, bounds = shard.all()
    assert (back == ids).all() and (bounds == ends).all()
    assert len(symbols) <= len(ids)


def test_packing(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)]
    out = packing.pack_documents(documents(spark, rows), BYTE, capacity=64).collect()
    t = Tokenizer.from_file(BYTE)
    by_doc, by_seq = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, x in rows:
        ids, own = [*t.encode(x or "", add_special_tokens=False).ids, 0], sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert all(r.length == 64 for r in own[1:])
        for r in own:
            assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert packing.pack_documents(documents(spark, rows).limit(0), BYTE).count() == 0
    whole = packing.sequences(documents(spark, rows), BYTE, capacity=64).collect()
    assert {r.sequence_id: len(r.ids) // 4 for r in whole} == {k: sum(r.length for r in v) for k, v in by_seq.items()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_best_fit_is_tightest(lengths):
    numbers, offsets = packing.best_fit_decreasing(np.array(lengths, np.int64), 50)
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):  # plain search for the tightest sequence
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms[rooms.index(min(fit))] -= n
        else:
            rooms.append(50 - n)
    used: dict[int, int] = {}
    for k, n in zip(numbers.tolist(), lengths, strict=True):
        used[k] = used.get(k, 0) + n
    assert sorted(50 - u for u in used.values()) == sorted(rooms)


def test_encoder_equals_the_library():
    """Against one call on each whole text, for both tokenizers, with a cache that overflows."""
    from speechstats.llm.tokens import Encoder

    texts = [t or "" for t in TEXTS] + ["ΑΣ. ΣΑΣ, aΣ!b Σ'x", "a|b |c| |", "don't!Don'T STOP's,'s", "x" * 22 + " " + "y" * 23 + " " + "z" * 40 + ".", "\x00 a\x00\x00 b\x00", "ÀÈ×÷!é.é?×!", "中文 字. 中文", "<|endoftext|> <|startoftext|>.", "a\u00a0 b \u2003c\x1f d"]
    raws = [t.encode() for t in texts]
    raw, offsets = np.frombuffer(b"".join(raws), np.uint8), np.r_[0, np.cumsum([len(x) for x in raws])]
    for path in (WORD, BYTE):
        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        own = Encoder(path, most=50)
        for _ in range(2):
            ids, bounds = own.encode(raw, offsets, 2)
            for k, x in enumerate(texts):
                assert ids[bounds[k] : bounds[k + 1]].tolist() == [*t.encode(x, add_special_tokens=False).ids, 2]


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("abcABé×ß.,'!|-\n\t 0\u00a0\u0301σΣ中"), max_size=60))
def test_encoder_on_any_text(text):
    from speechstats.llm.tokens import encoder

    raw = np.frombuffer(text.encode(), np.uint8)
    for path in (WORD, BYTE):
        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        assert encoder(path).encode(raw, np.array([0, len(raw)]))[0].tolist() == t.encode(text, add_special_tokens=False).ids


def test_token_files_in_several_shards(spark):
    """The byte vocabulary is over the default base; rows of one doc_id come in the order of their texts."""
    rows = [(k // 3, words(k % 7, 60)) for k in range(40)]
    t = Tokenizer.from_file(BYTE)
    for _ in range(2):
        path = scratch_path(spark, "t")
        repair.write_ids(documents(spark, rows), path, BYTE, 50256, shard_ids=500)
        shards = spark.read.parquet(path)
        assert shards.count() > 8 and shards.selectExpr("max(base)").first()[0] == 50257
        out = repair.read_ids(spark, path).orderBy("start").collect()
        sizes = {}
        for i, x in rows:
            ids = [*t.encode(x, add_special_tokens=False).ids, 50256]
            sizes.setdefault(i, []).append(zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert [r.start for r in out] == np.r_[0, np.cumsum([r.n_tokens for r in out])[:-1]].tolist()
        assert [r.doc_id for r in out] == sorted(i for i, _ in rows)
        got = {}
        for r in out:
            got.setdefault(r.doc_id, []).append(r.ids_crc32)
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in sizes.items()}


def test_repair_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(3)
    ids = np.tile(rng.integers(0, 40, 300), 200).astype(np.uint16)
    for base, kind in ((49408, np.uint16), (70_000, np.uint32)):
        symbols, _, rules, lengths = repair.compress(ids, np.array([len(ids)]), base)
        pairs = symbols[:-1].astype(np.int64) << 32 | symbols[1:]
        assert symbols.dtype == kind and np.unique(pairs, return_counts=True)[1].max() < repair.LEAST and lengths.max() >= 200


def test_packing_in_several_groups(spark):
    rows = [(k, words(k % 5, 30)) for k in range(60)]
    parts = packing.pieces(documents(spark, rows), BYTE, capacity=512, with_ids=False)
    out = packing.pack(parts.persist(), 512, group=10).collect()
    assert len({r.sequence_id >> 32 for r in out}) > 2 and sorted(r.doc_id for r in out) == list(range(60))
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 512


def test_chat_with_many_turns(spark):
    """Places stay right over several blocks of running sums; a very long text; a clashing column."""
    rows = [(1, k, ("user", "assistant")[k % 3 == 1], f"t{k} [INST] é") for k in range(1500)] + [(2, 0, "assistant", "</s>é" * 50_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, at int")
    out = {r.conv_id: r for r in chat.digest(chat.parse_chats(chat.format_chats(df))).collect()}
    for conv in (1, 2):
        own = [r for r in rows if r[0] == conv]
        learnt = "".join(t for _, _, role, t in own if role == "assistant")
        assert out[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in own).encode()).hexdigest()
        assert (out[conv].loss_chars, out[conv].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
