from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from ledgerflow.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH),
                             special_tokens={})


def random_texts(n):
    r = random.Random(11)
    parts = ["a", "b", "th", "ing", "The", " ", "  ", "\n", "\t", "é", "ß", "中", "文", "\U0001f600", "0", "12", "!", "$$", "'s",
             "́", "한", "ا", "ation", "x" * 40, "<|endoftext|>"]
    for _ in range(n):
        yield "".join(r.choice(parts) for _ in range(r.randint(0, 60)))
        yield "".join(chr(r.choice([r.randint(32, 126), r.randint(160, 0x24F), r.randint(0x400, 0x4FF),
                                    r.randint(0x3040, 0x30FF), r.randint(0x1F300, 0x1F6FF)])) for _ in range(r.randint(0, 40)))


def test_ids_equal_the_library(library, small):
    encoder, _ = bpe.coder(PATH, public_tokenizers.PATTERN)
    texts = [r["text"] or "" for r in small.collect()] + list(random_texts(400)) + ["a" * 5000, " " * 3000, "ath" * 2000]
    assert [encoder.encode(t) for t in texts] == library.encode_ordinary_batch(texts)


def test_another_vocabulary_and_small_state_tables(library, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    other = tiktoken.Encoding("o", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    monkeypatch.setattr(bpe, "MAX_STATES", 40)
    monkeypatch.setattr(bpe, "MAX_PIECES", 5)
    encoder = bpe.Encoder(bpe.load_ranks(path), public_tokenizers.PATTERN)
    for t in list(random_texts(60)) + ["supercalifragilistic" * 30]:
        assert encoder.encode(t) == other.encode_ordinary(t)


def test_the_last_byte_of_a_piece_makes_no_state(library):
    """Nothing reads the state after the last byte, so it is neither worked out nor kept."""
    machine = bpe.Transducer(bpe.load_ranks(PATH))
    assert machine.encode(b"") == [] and len(machine.states) == 1
    for word in (b"qzx", b" quixotry", "中文한".encode(), b"zzxqj"):
        machine.clear()
        assert machine.encode(word) == library.encode_ordinary(word.decode())
        assert len(machine.moves) == len(word) - 1
        assert machine.encode(word) == library.encode_ordinary(word.decode())  # from kept moves


def test_tokens_come_after_bounded_lookahead(library):
    """Portions of any size give the same ids, and no more than two longest tokens are held back."""
    machine = bpe.coder(PATH, public_tokenizers.PATTERN)[0].machine
    r = random.Random(6)
    for text in ("internationalisation" * 20, " " * 300, "abcdefghijklmnopqrstuvwxyz" * 10, "ath" * 300, "x" * 700):
        data, at, done, ids, stream = text.encode(), 0, 0, [], bpe.Stream(machine)
        while at < len(data):
            n = r.randint(1, 9)
            certain = stream.feed(data[at:at + n])
            at = min(len(data), at + n)
            done += sum(len(machine.tokens[t]) for t in certain)
            assert at - done == len(stream.last) <= 2 * machine.longest
            ids += certain
        whole = ids + stream.finish()
        assert b"".join(machine.tokens[t] for t in whole) == data
        assert whole == library._core_bpe.encode_single_piece(data)


def test_state_machine_accepts_what_utf8_is():
    def accepts(data):
        state = bpe.BETWEEN
        for b in data:
            state = bpe.utf8_step(state, b)
        return state == bpe.BETWEEN

    def valid(data):
        try:
            data.decode("utf-8")
        except UnicodeDecodeError:
            return False
        return True

    r = random.Random(4)
    edges = [0x00, 0x7F, 0x80, 0x8F, 0x90, 0x9F, 0xA0, 0xBF, 0xC0, 0xC1, 0xC2, 0xDF, 0xE0, 0xE1, 0xEC, 0xED, 0xEE, 0xEF, 0xF0,
             0xF1, 0xF3, 0xF4, 0xF5, 0xFF]
    for _ in range(60_000):
        data = bytes(r.choice(edges) for _ in range(r.randint(0, 5)))
        assert accepts(data) == valid(data), data


def test_decoding_in_portions(library):
    encoder, decoder = bpe.coder(PATH, public_tokenizers.PATTERN)
    r = random.Random(8)
    for text in random_texts(150):
        ids, data, state = encoder.encode(text), b"", bpe.BETWEEN
        at = 0
        while at < len(ids):
            n = r.randint(1, 5)
            part, state = decoder.feed(state, ids[at:at + n])
            data += part
            at += n
            expect = bpe.BETWEEN
            for b in data:
                expect = bpe.utf8_step(expect, b)
            assert state == expect
        assert data.decode() == text and state == bpe.BETWEEN
    assert decoder.feed(bpe.BETWEEN, [encoder.ranks[b"\x80"]])[1] == bpe.INVALID


@pytest.mark.parametrize("table", ["edge", "small"])
def test_round_trip_rows(request, library, table):
    docs = request.getfixturevalue(table)
    rows = [tuple(r) for r in bpe.round_trip(docs, PATH, public_tokenizers.PATTERN).collect()]
    want = []
    for r in docs.collect():
        ids = library.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((r["text"] or "").encode()).hexdigest(), True))
    assert sorted(rows, key=repr) == sorted(want, key=repr)


def test_ids_and_no_rows(edge, none, library):
    for r in bpe.encode(edge, PATH, public_tokenizers.PATTERN).join(edge.select("doc_id", "text"), "doc_id").where(
            "doc_id < 12").collect():
        assert r["ids"] == library.encode_ordinary(r["text"] or "")
    assert bpe.encode(none, PATH, public_tokenizers.PATTERN).count() == 0
