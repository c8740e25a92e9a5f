import io
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from ratepanel.llm import tokenfiles
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def expected(rows, tokenizer):
    for i, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        yield i, ids


@pytest.mark.parametrize("which", ["odd", "some"])
def test_round_trip(which, odd_docs, odd_rows, some_docs, some_rows, tokenizer):
    docs, rows = (odd_docs, odd_rows) if which == "odd" else (some_docs, some_rows)
    manifest = tokenfiles.write_files(docs, PATH)
    found = sorted(tokenfiles.read_files(manifest).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    start = 0
    for r in found:
        assert r["start"] == start
        start += r["n_tokens"]
    whole = sorted(((i, len(ids), zlib.crc32(ids.tobytes())) for i, ids in expected([r[:2] for r in rows], tokenizer)), key=str)
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found), key=str) == whole
    own = dict(expected([r[:2] for r in rows if r[0] in (1, 5, 14)], tokenizer))
    for i, ids in tokenfiles.fetch(manifest, [1, 5, 14]):
        assert ids.tolist() == own[i].tolist()


@pytest.mark.parametrize(
    "text",
    ["", " ", "  ", "a  b", " lead", "trail ", "a \n b", "a\n\n  b c", "it's  we'll", "x  y", "x  y", "\x1c a \x1c b", "tab\t tab", "<|endoftext|> a <|endoftext|>", "é à ñ 日本 語", "1 2  3 4.5", "a,b. c!! d** (e) 'f', g's. h'.", "x.\ny, z\n\nw \nv\n u", "...", "a\n", "\na b", "5% 6$ ²., x²,", "a…, b」."],
)
def test_words_encode_as_the_whole(text, tokenizer):
    with open(PATH, encoding="utf-8") as source:
        encoder = tokenfiles.Encoder(source.read())
    ids = np.frombuffer(encoder.encode([text])[0], dtype="<u4")
    assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [2]


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def file_of(documents):
    out = io.BytesIO()
    writer = tokenfiles.Writer(out)
    for doc_id, ids in documents:
        writer.add(doc_id, ids)
    writer.close()
    return out.getvalue()


def test_only_wanted_frames_are_read():
    rng = np.random.default_rng(1)
    documents = [(i if i != 3 else None, rng.integers(0, 50_000, int(n)).astype("<u4").tobytes()) for i, n in enumerate(rng.integers(0, 90_000, 40))]
    data = file_of(documents)
    reader = tokenfiles.Reader.open(Source(data))
    assert len(reader.packed) > 10 and reader.doc_ids[3] is None
    read = []
    content = reader._content
    reader._content = lambda frame, offset: read.append(frame) or content(frame, offset)
    assert list(reader.documents([7])) == [(7, documents[7][1])]
    assert len(read) <= 3
    assert [d for _, d in reader.documents()] == [d for _, d in documents]
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert plain == b"".join(d for _, d in documents)


def test_damage_is_found():
    data = bytearray(file_of([(1, b"abcd" * 1000)]))
    table = data.rfind(b"\x5e\x2a\x4d\x18")
    data[table + 16] ^= 1
    with pytest.raises(ValueError):
        list(tokenfiles.Reader.open(Source(bytes(data))).documents())


def test_no_rows(no_docs):
    assert tokenfiles.read_files(tokenfiles.write_files(no_docs, PATH)).count() == 0


def test_random_texts_encode_as_the_whole(tokenizer):
    with open(PATH, encoding="utf-8") as source:
        encoder = tokenfiles.Encoder(source.read())
    rng = np.random.default_rng(7)
    letters = list("abtheIN019 ,.!?*&%$#|'\"-()<>\n\t \u00a0éñß語😀_²Ⅷ") + [" ", " the", " is", "'s", "<|endoftext|>", "\r\n", "\x1c", "  "]
    texts = ["".join(rng.choice(letters, int(n))) for n in rng.integers(0, 60, 3000)]
    whole = tokenizer.encode_batch(texts, add_special_tokens=False)
    for text, ids, found in zip(texts, encoder.encode(texts), whole):
        assert np.frombuffer(ids, dtype="<u4").tolist() == found.ids + [2], repr(text)


def test_other_definitions_encode_whole():
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as source:
        encoder = tokenfiles.Encoder(source.read())
    ids = np.frombuffer(encoder.encode(["Hello  World, again"])[0], dtype="<u4")
    assert ids.tolist() == Tokenizer.from_file(path).encode("Hello  World, again", add_special_tokens=False).ids + [2]


def test_words_are_looked_up_by_their_letters(tokenizer, monkeypatch):
    """Once a chunk, whatever marks follow them, and not again while one of the last two tables has them."""
    with open(PATH, encoding="utf-8") as source:
        encoder = tokenfiles.Encoder(source.read())
    monkeypatch.setattr(tokenfiles, "MEMO", 6)
    found, stem = [], encoder._stem
    monkeypatch.setattr(encoder, "_stem", lambda word: found.append(word) or stem(word))
    chunks = [["one two, two. two!\ntwo; 3x", "... one? ünï, it's (a) a). --"], ["six seven\neight (nine) ten", "two three"], ["one one, eleven"], ["two"]]
    for texts in chunks:
        ids = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
        assert ids == [tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert found.count("two") == found.count("\ntwo") == 1
    assert found.count("\none") == 2  # its table is the third last by then
