"""Unigram models: a model of a few pieces, written here, against the library and against all paths."""

from __future__ import annotations

import random
import struct

import pytest
import sentencepiece

from fleetspark.llm.pieces import SPACE, Pieces


def field(number, value):
    """One field of a protocol buffer message."""
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def model_file(path, pieces, fallback):
    """pieces: text, score. Piece 0 is the unknown one; with ``fallback`` the 256 bytes follow."""
    rows = [field(1, b"<unk>") + field(2, 0.0) + field(3, 2)]
    if fallback:
        rows += [field(1, f"<0x{b:02X}>".encode()) + field(2, 0.0) + field(3, 6) for b in range(256)]
    rows += [field(1, p.encode()) + field(2, s) + field(3, 1) for p, s in pieces]
    trainer = field(3, 1) + (field(35, 1) if fallback else b"") + field(40, 0) + field(41, 0xFFFFFFFFFFFFFFFF) + field(42, 0xFFFFFFFFFFFFFFFF) + field(43, 0xFFFFFFFFFFFFFFFF)
    rules = field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1)
    path.write_bytes(b"".join(field(1, r) for r in rows) + field(2, trainer) + field(3, rules))
    return str(path)


def all_paths(text, arcs):
    """Every way through a text by pieces or, where none is of one character, by that character."""
    if not text:
        yield []
        return
    for end in range(1, len(text) + 1):
        part = text[:end]
        if part in arcs or end == 1:
            for rest in all_paths(text[end:], arcs):
                yield [part, *rest]


@pytest.mark.parametrize("fallback", [True, False])
def test_shortest_paths(tmp_path, fallback):
    rng = random.Random(3)
    found = {SPACE: -2.0, "a": -3.0, "b": -3.5, "c": -4.0}
    while len(found) < 40:
        piece = rng.choice(["", "", SPACE]) + "".join(rng.choices("abc", k=rng.randint(1, 4)))
        if piece:
            found.setdefault(piece, round(-rng.uniform(1.5, 9), 3))
    path = model_file(tmp_path / "u.model", list(found.items()), fallback)
    machine, library = Pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    assert not machine.merging
    texts = ["".join(rng.choices(["a", "b", "c", "ab", " ", "  ", "é", "日"], [6, 5, 4, 3, 3, .5, .3, .3], k=rng.randint(0, 9))) for _ in range(400)]
    got = [list(memoryview(g).cast("i")) for g in machine.encode(texts)]
    assert [machine.decode(g) for g in machine.encode(texts)] == texts if fallback else True
    for text, ids in zip(texts, got, strict=True):
        want = library.encode(text)
        # without bytes the library writes neighbouring unknown characters as one
        assert (ids if fallback else [i for k, i in enumerate(ids) if i or k == 0 or ids[k - 1]]) == want, text
    floor = min(machine.score) - 10.0

    def weight(parts):
        return sum(-(machine.score[machine.arcs[p]] if p in machine.arcs else floor) for p in parts)

    short = sorted({machine.normalised(t) for t in texts if 0 < len(t) < 8})
    for text, parts in zip(short, machine.paths(short), strict=True):
        assert "".join(parts) == text
        assert weight(parts) == pytest.approx(min(weight(p) for p in all_paths(text, machine.arcs)), abs=1e-6)


def test_merging_is_the_only_finite_path(tmp_path):
    """Of all paths through a few characters one alone has an arc of the pair acceptor at every step: the one that is found."""
    import public_tokenizers

    machine = Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(5)
    texts = sorted({SPACE + "".join(rng.choices("theinarso", k=rng.randint(1, 7))) for _ in range(60)})
    for text, parts in zip(texts, machine.paths(texts), strict=True):
        finite = [p for p in all_paths(text, machine.arcs) if all(machine.follows(a, b) for a, b in zip(["", *p], p, strict=False))]
        assert finite == [parts]
