import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from genospan.llm import pieces, tokenfile

BPE = public_tokenizers.path("byte_bpe_50k.json")
SPM = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "  a   b  ", "x\n y", "x \ny", "\n\n a\t b", "Größe – naïve  　 x", "▁a ▁", "don't we'll 's", "\xa0 \x1c \x85z", "日本 語 です", "😀 😀a 12 34.5", "<s> </s> <|endoftext|>", "﻿ a​ b", "a" * 3000 + " " * 70 + "b" * 200]
texts = st.text(alphabet=st.one_of(st.sampled_from(" \n\t'ab1.,▁é語\x1c\xa0"), st.characters(exclude_categories=["Cs"])), max_size=60)


@pytest.fixture(scope="module")
def bpe():
    return Tokenizer.from_file(BPE), tokenfile.UnitEncoder(BPE, added=True)


@pytest.fixture(scope="module")
def spm():
    return sentencepiece.SentencePieceProcessor(model_file=SPM), pieces.PieceEncoder(SPM)


def same_bpe(bpe, text):
    assert np.frombuffer(bpe[1].encode([text])[0], "<u4").tolist() == bpe[0].encode(text, add_special_tokens=False).ids


def same_spm(spm, text):
    ids, ends, decoded = spm[1].encode([text])[0]
    want = spm[0].encode(text, add_bos=True, add_eos=True)
    assert ids.tolist() == want
    assert decoded.decode() == spm[0].decode(want)
    assert len(ends) == len(want) - 2
    raw = text.encode()
    if len(ends):
        assert ends[-1] == len(raw) and (np.diff(ends) >= 0).all()
        for a, b, i in zip([0, *ends], ends, want[1:-1], strict=False):
            piece = spm[0].id_to_piece(i)
            own = raw[a:b].decode(errors="replace").replace("▁", " ")
            if not spm[0].is_byte(i):
                assert own == piece.replace("▁", " ") or f" {own}" == piece.replace("▁", " ")


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(bpe, spm, text):
    same_bpe(bpe, text)
    same_spm(spm, text)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_random_texts(bpe, spm, text):
    same_bpe(bpe, text)
    same_spm(spm, text)


def test_units_are_forgotten_at_the_bound(bpe):
    small = tokenfile.UnitEncoder(BPE, memory=5)
    rows = [f"w{i} the w{i + 1}" for i in range(20)]
    assert small.encode(rows[:3]) + small.encode(rows[3:]) == bpe[1].encode(rows)
    tiny = pieces.PieceEncoder(SPM, memory=5)
    assert [x[0].tolist() for x in tiny.encode(rows[:4]) + tiny.encode(rows[4:])] == [x[0].tolist() for x in pieces.PieceEncoder(SPM).encode(rows)]


def trie(entries):
    """A small compiled map, built in the public double-array layout."""
    strings, at = b"", {}
    for v in sorted(set(entries.values())):
        at[v] = len(strings)
        strings += v + b"\0"
    tree = {}
    for k, v in entries.items():
        node = tree
        for b in k:
            node = node.setdefault(b, {})
        node[None] = at[v]
    units, used = {0: 0}, {0}

    def place(node, pos, label):
        keys = [k for k in node if k is not None]
        base = 256
        while any(base ^ c in used for c in [0, *keys]):
            base += 1 if base & 0xFF != 0xFF else 1
        used.update(base ^ c for c in [0, *keys])
        units[pos] = (label or 0) | (base ^ pos) << 10 | (256 if None in node else 0)
        if None in node:
            units[base] = node[None] | 0x80000000
        for k in keys:
            place(node[k], base ^ k, k)

    place(tree, 0, 0)
    size = max(units) + 257
    raw = np.zeros(size, "<u4")
    for p, u in units.items():
        raw[p] = u
    return struct.pack("<I", size * 4) + raw.tobytes() + strings


def test_character_map_takes_longest_prefix_and_keeps_source_offsets():
    cmap = pieces.CharacterMap(trie({"ﬁ".encode(): b"fi", b"a": b"A", b"ab": b"x", "　".encode(): b" "}))
    norm, origin = pieces.normalise("abaﬁ　z".encode(), cmap)
    assert norm.decode() == "▁xAfi▁z"
    assert origin.tolist() == [0, 0, 0, 0, 2, 3, 3, 6, 6, 6, 9, 10]
    norm, origin = pieces.normalise("  a  　b ".encode(), cmap, squeeze=True)
    assert norm.decode() == "▁A▁b" and origin[-1] == 9
    assert pieces.normalise(b"", cmap)[0] == b""


def documents(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["the", "of", "naïve", "x1,", "\n", ""], k=rng.randint(0, 60))), "s", 7) for i in rng.sample(range(10_000), 120)]
    rows += [(10_001, None, None, 1), (-5, "", "s", None), (10_002, "word " * 20_000, "s", 1), (3_000_000_000, "last", "s", 1), (None, "no id", "s", 1), (rows[0][0], "again", "s", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, start string, n_tokens int")


def test_files_round_trip(spark, bpe, tmp_path):
    docs = documents(spark)
    manifest = tokenfile.write_tokens(docs, BPE, f"file://{tmp_path}/shards", shards=3)
    rows = tokenfile.read_tokens(spark, manifest).collect()
    want = sorted(((r.doc_id, bpe[0].encode(r.text or "", add_special_tokens=False).ids + [0]) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, len(x[1])))
    rows.sort(key=lambda r: r.start)
    assert [(r.doc_id, list(np.frombuffer(r.ids, "<u4"))) for r in rows] == want
    assert [r.start for r in rows] == [0, *np.cumsum([len(x[1]) for x in want])[:-1].tolist()]
    got = {r.start: r for r in tokenfile.token_digests(docs, BPE).collect()}
    assert all(got[r.start].ids_crc32 == zlib.crc32(r.ids) and got[r.start].n_tokens == r.n_tokens for r in rows)
    assert tokenfile.token_digests(docs.where("false"), BPE).count() == 0
    # Random access, and the file as any zstandard tool sees it.
    path = manifest[-1]["path"]
    reader = tokenfile.ShardReader(path)
    (k,) = reader.find(3_000_000_000)
    assert np.frombuffer(reader.read(k), "<u4").tolist() == want[-1][1]
    assert reader.find(77_777) == []
    with open(path.removeprefix("file://"), "rb") as f:
        raw = f.read()
    whole = b"".join(ids for _, ids in reader.scan(span=100))
    assert zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read() == whole
    bad = tmp_path / "bad.zst"
    at = int(reader.starts[k]) + 12
    bad.write_bytes(raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1 :])
    with pytest.raises((ValueError, zstandard.ZstdError)):
        tokenfile.ShardReader(f"file://{bad}").read(k)


def test_piece_digests(spark, spm):
    docs = documents(spark)
    full = {(r.doc_id, len(r.ids)): r for r in pieces.encode_documents(docs, SPM).collect()}
    texts = {(r.doc_id, len(ids)): (ids, r.text or "") for r in docs.collect() for ids in [spm[0].encode(r.text or "", add_bos=True, add_eos=True)]}
    for r in pieces.encode_documents(docs, SPM, digests=True).collect():
        ids, text = texts[r.doc_id, r.n_tokens]
        assert full[r.doc_id, r.n_tokens].ids == ids
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(spm[0].decode(ids).encode()).hexdigest()
        assert r.n_source_bytes == len(text.encode())
    assert pieces.encode_documents(docs.where("false"), SPM).count() == 0


def test_added_tokens_are_the_librarys(spark):
    library = Tokenizer.from_file(BPE)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y <|endoftext", "plain words", "", "é <|endoftext|>\n z"]
    assert library.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    start = 0
    for r, t in zip(tokenfile.token_digests(docs, BPE).orderBy("doc_id").collect(), texts, strict=True):
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
