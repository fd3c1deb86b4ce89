"""Byte-pair coding, packing and chat formatting."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from casewise.llm import bpe, chat, packing
from casewise.llm.queries import ORACLES, tokenizer


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(tokenizer())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_tables(tokenizer()))


def encoded(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_codec_matches_library(library, codec, texts):
    for text, ids in zip(texts.values(), codec.encode_all(texts.values())):
        assert ids.tolist() == encoded(library, text)


def test_codec_on_odd_texts(library, codec):
    rng = random.Random(1)
    letters = "abcdeiorstth  nE.,!'0189é́ΣßİǅñÖ中文😀​\x1c\n　ſ²Ⅷ_-|"
    odd = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) + rng.choice(["", "<|endoftext|>a", "<|end"]) for _ in range(3000)]
    odd += ["x" * 20_000, "ab" * 500, "'s't" * 50, ""]
    for text, ids in zip(odd, codec.encode_all(odd)):
        assert ids.tolist() == encoded(library, text)
        assert codec.decode(ids.tolist()) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_small_tables_change_nothing(library, texts, monkeypatch):
    monkeypatch.setattr(bpe, "WORDS_HELD", 50)
    monkeypatch.setattr(bpe, "BATCH_CHARS", 500)
    codec = bpe.Codec(bpe.read_tables(tokenizer()))
    some = list(texts.values())[:40]
    assert [x.tolist() for x in codec.encode_all(some)] == [encoded(library, t) for t in some]


def test_more_words_than_the_table_holds(library, monkeypatch):
    """One chunk holds many words, some of over 16 letters: the table's bound falls within a block."""
    monkeypatch.setattr(bpe, "WORDS_HELD", 20)
    codec = bpe.Codec(bpe.read_tables(tokenizer()))
    rng = random.Random(7)
    for _ in range(5):
        some = [".".join("".join(rng.choice("abcdeort") for _ in range(rng.choice([2, 3, 5, 17, 25]))) for _ in range(12)) + " end" for _ in range(15)]
        assert [x.tolist() for x in codec.encode_all(some)] == [encoded(library, t) for t in some]
        assert len(codec.words) <= 20


def test_round_trip_query(results, library, texts):
    for r in results("op5_bpe_round_trip"):
        ids = encoded(library, texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_coding_edges(edge, nothing, library):
    out = bpe.decode_documents(bpe.encode_documents(edge, tokenizer(), ids="id"), tokenizer(), ids="_id", decoded="key")
    assert out.columns == [*edge.columns, "_id", "_key"]
    for r in out.collect():
        assert r["_id"] == encoded(library, r.text) and r["_key"] == library.decode(r["_id"], skip_special_tokens=False)
    assert bpe.round_trip(edge, tokenizer()).count() == edge.count() and bpe.round_trip(nothing, tokenizer()).count() == 0


def check_pieces(pieces, documents, library):
    """Pieces rebuild every document's ids; sequences are gapless and within capacity. Returns the sequences' sizes."""
    by_row, sequences = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_row[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, texts in documents.items():
        want = sorted(zlib.crc32(np.array([*encoded(library, t), 1], "<u4").tobytes()) for t in texts)
        if len(texts) > 1:
            assert sum(r.length for r in by_row[i]) == sum(len(encoded(library, t)) + 1 for t in texts)
            continue
        ids, at = np.array([*encoded(library, texts[0]), 1], "<u4"), 0
        for r in sorted(by_row[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids) and want
    sizes = []
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
        sizes.append(at)
    return sizes


def test_packing_query(results, library, texts):
    sizes = check_pieces(results("op7_packing"), {i: [t] for i, t in texts.items()}, library)
    assert sum(packing.CAPACITY - s for s in sizes) < packing.CAPACITY  # one task read them all


def test_packing_edges(edge, nothing, library):
    documents = defaultdict(list)
    for r in edge.collect():
        documents[r.doc_id].append(r.text)
    check_pieces(packing.pack(edge, tokenizer()).collect(), documents, library)
    assert packing.pack(nothing, tokenizer()).count() == 0


def test_rounds_carry_over(spark, texts, library, monkeypatch):
    packer = packing._Packer(5, 64)
    for i, t in enumerate(list(texts.values())[:60]):
        packer.add(i, np.array([*encoded(library, t), 1], np.uint16))
        if packer.tokens >= 500:
            packer.close_round(False)
    packer.close_round(True)
    filled = defaultdict(int)
    for _, _, size, _, _, sequence, offset in packer.out:
        assert offset == filled[sequence]
        filled[sequence] += size
    assert sum(64 - v for v in filled.values()) < 64 and min(filled) == 5 and max(filled) == 4 + len(filled)


def test_balance_evens_out_cost():
    lengths = [900, 700, 400, 300, 300, 200, 100, 100, 1000, 96]
    placed, rest = packing.balance(lengths, 2)
    assert not rest and sum(size for _, _, size, _ in placed) == sum(lengths)
    load = [sum(packing.cost(size) for _, _, size, b in placed if b == k) for k in range(2)]
    assert max(load) / min(load) < 1.1
    assert packing.balance([5, 5], 1, 8) == ([(0, 0, 5, 0), (1, 0, 3, 0)], [(1, 3, 2)])


def test_chat_matches_sql(results, tables):
    rows = tables.execute(ORACLES["op4_chat_format"]).fetchall()
    assert sorted(map(tuple, results("op4_chat_format"))) == sorted(rows)


def test_chat_parts_round_trip(spark):
    part = lambda kind, text=None, ref=None, w=None, h=None, s=None, p=None: (kind, text, ref, w, h, s, p)
    texts = ["\\### Assistant: </turn> ok", "<image:0> \\b\\l\\h\\c", "a\n### user: b</turn>\n", "", None, "😀#<"]
    rows = [
        (1, 0, "user", [part("text", texts[0]), part("image", ref="i1", w=57, h=28), part("text", texts[1]), part("audio", ref="s", s=1.5)]),
        (1, 1, "assistant", [part("text", texts[2]), None, part("document", ref="d", p=3), part("other", "as text")]),
        (1, None, "a:b\n### x: ", []), (1, 1, None, None), (2, 5, "assistant", [part("text", texts[4])]), (None, 1, "user", [part("text", texts[5])]),
        (2, 4, "assistant", [part("text", texts[5])]), (2, 4, "assistant", [part("text", texts[5])]),
    ]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    out = chat.format_chat(turns).select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    got = {r.conv_id: r for r in out.collect()}
    assert [tuple(t) for t in got[1].turns] == [
        ("a:b\n### x: ", ""), ("user", texts[0] + texts[1]), ("", ""), ("assistant", texts[2] + "as text")]
    assert [tuple(a) for a in got[1].attachments] == [("image", "i1", "<image:0>", 3), ("audio", "s", "<audio:1>", 38), ("document", "d", "<document:0>", 1536)]
    assert got[1].attachment_tokens == 3 + 38 + 1536 and got[1].loss == texts[2] + "as text"
    assert [t.text for t in got[2].turns] == [texts[5], texts[5], ""] and got[2].loss == texts[5] * 2
    assert got[None].loss == "" and chat.format_chat(turns.filter("false")).count() == 0


def test_chat_runs_no_python(spark, tiny):
    from casewise.llm.queries import QUERIES

    plan = QUERIES["op4_chat_format"](spark, tiny)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_balance_follows_the_plain_rule():
    """Every piece goes where a look at all sequences would put it."""
    import random

    rng = random.Random(6)
    for _ in range(300):
        capacity = rng.choice([7, 64, 2048])
        lengths = [rng.choice([rng.randint(1, capacity - 1), rng.randint(1, 5), capacity // 2]) for _ in range(rng.randint(0, 60))]
        bins = rng.choice([sum(lengths) // capacity, -(-sum(lengths) // capacity), 3])
        room, load, placed, rest = [capacity] * bins, [0.0] * bins, [], []
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            start, left = 0, lengths[i]
            while left:
                fits = [b for b in range(bins) if room[b] >= left] or [b for b in range(bins) if room[b] > 0]
                if not fits:
                    rest.append((i, start, left))
                    break
                b = min(fits, key=lambda b: (load[b], b))
                size = min(left, room[b])
                placed.append((i, start, size, b))
                room[b] -= size
                load[b] += packing.cost(size)
                start, left = start + size, left - size
        assert packing.balance(lengths, bins, capacity) == (placed, rest)
