import hashlib
import random

import numpy as np
import pytest
import tiktoken

from docquill.llm import bpe

PATH, PATTERN = bpe.vocabulary()


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(1)
    alphabets = ["abcdefghijklmnopqrstuvwxyzABC", "etaoin-=_. \n", "éа中あ\U0001f600a ‍́", "0123456789,.", " \t\n\r\x0b\x85　\xa0x"]
    yield from ("", "a", "<|endoftext|>", "it's we'll I'D", "a" * 5000, " " * 3000 + "x", "\x00\xff", "�﻿")
    for _ in range(1500):
        yield "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randrange(60)))


def test_against_the_library(ranks, library):
    for states, pieces in ((bpe.STATES, bpe.PIECES), (20, 5)):
        coder, stream = bpe.Encoder(ranks, PATTERN, pieces, states), bpe.Utf8Stream(bpe.token_table(ranks))
        for text in texts():
            ids = np.frombuffer(coder.packed(text), "<u4").tolist()
            assert ids == library.encode_ordinary(text), text[:50]
            assert stream.decode(ids) == text.encode()


def test_every_token_pair_is_judged_as_merging_does(ranks, library):
    rng, machine, ids = random.Random(3), bpe.Transducer(ranks), list(ranks.values())
    for _ in range(3000):
        a, b = rng.choice(ids), rng.choice(ids[:2000])
        if machine.spine(a) is None or machine.spine(b) is None:
            continue
        merged = [ranks[p] for p in machine.merged(machine.tokens[a] + machine.tokens[b])[0]]
        assert machine.fits(machine.spine(a)[1], b) == (merged == [a, b])


def test_streaming_decode_gives_whole_characters(ranks):
    stream = bpe.Utf8Stream([bytes([b]) for b in range(256)])
    text = "aé中\U0001f600z"
    out = [stream.feed(b) for b in text.encode()]
    assert [x for x in out if x] == [c.encode() for c in text] and stream.finish() == b""
    stream.feed(0xE4)
    assert stream.finish() == b"\xe4"
    assert bpe.Utf8Stream([bytes([b]) for b in range(256)]).decode([0xFF, 0x80, 0xC3]) == b"\xff\x80\xc3"


def test_operator(make, library):
    rows = [(1, "Hello world"), (2, None), (3, ""), (1, "Hello world"), (4, "é" * 3000)]
    got = bpe.encoded(make(rows), PATH, PATTERN).collect()
    assert len(got) == 5 and all(r["same"] for r in got)
    for r in got:
        ids = library.encode_ordinary(r["text"] or "")
        assert r["n_tokens"] == len(ids) and bytes(r["ids"]) == np.array(ids, "<u4").tobytes()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest() and r["row"]["size"] == "src"
    assert bpe.encoded(make([]), PATH, PATTERN).count() == 0


def test_states_without_moves_share_one_table_and_clearing_changes_nothing():
    ranks = bpe.load_ranks(bpe.vocabulary()[0])
    rng = random.Random(8)
    words = [" " + "".join(rng.choice("aeinorstléü") for _ in range(rng.randrange(2, 14))) for _ in range(400)]
    large, small = bpe.Transducer(ranks), bpe.Transducer(ranks, 20)
    for w in words:
        assert large.encode(w.encode()) == small.encode(w.encode()) == [ranks[p] for p in large.merged(w.encode())[0]]
    assert not bpe.NO_MOVES and any(m is bpe.NO_MOVES for m in large.moves) and len(small.state) < 100


def test_last_bytes_and_edges_that_no_longer_matter_make_no_states(ranks):
    rng = random.Random(9)
    parts = "an in th er on re st en de la tion ing ent es keit heit ción ñé".split()
    words = [(" " + "".join(rng.choice(parts) for _ in range(rng.randrange(2, 6)))).encode() for _ in range(3000)]
    large, small = bpe.Transducer(ranks), bpe.Transducer(ranks, 20)
    for w in words:
        assert large.encode(w) == small.encode(w) == ([ranks[w]] if w in ranks else [ranks[p] for p in large.merged(w)[0]])
    assert len(large.state) < 3500  # 3,895 when a word's last byte led to a state and used-up edges told states apart


def test_decoding_goes_step_by_step_only_where_a_character_is_open(ranks):
    stream = bpe.Utf8Stream([bytes([b]) for b in range(256)] + ["aé中".encode()])
    text = "aé中\U0001f600z"
    assert stream.decode(list(text.encode()) + [256, 0xE4, 256]) == text.encode() + "aé中".encode() + b"\xe4" + "aé中".encode()
    assert set(stream.steps[b""]) == {0xC3, 0xE4, 0xF0} and stream.decode([]) == b""
