"""Words as arrays, against plain Python, and what their hashes cost."""

import random
import re

import pyarrow as pa

from lectio.llm import tokens

WORD = rb"[^\x20\x09-\x0D]+"


def parsed(texts, fold=False):
    """``[(text, line, word, hash)]`` of all words."""
    out = []
    for a, _, words in tokens.slices(pa.array(texts, pa.binary()), fold):
        owner, line = words.lines()
        raw = [words.data[i:j].tobytes() for i, j in zip(words.start.tolist(), words.stop.tolist())]
        out += zip((owner + a).tolist(), line.tolist(), raw, words.hash.tolist())
    return out


def test_words_lines_and_hashes():
    r = random.Random(2)
    texts = [b"a\x00 a a\x00\x00 b\x00\x00\x00" * 9, b"x" * 64 + b" " + b"x" * 65 + b"\n" + b"y" * 200_000, b"", b"glued", b"to this\x0bone \t", b"\n\n\na\nb"]
    texts += [bytes(r.choices(b"ab \n\t\x85\xa0", k=r.randrange(300))) for _ in range(500)]
    texts += [b" ".join(bytes(r.choices(b"ab", k=r.randrange(1, 90))) for _ in range(50)) for _ in range(100)]
    got = parsed(texts)
    assert [g[:3] for g in got] == [(t, k, w) for t, text in enumerate(texts) for k, line in enumerate(text.split(b"\n")) for w in re.findall(WORD, line)]
    known = {}
    assert all(known.setdefault(w, h) == h for _, _, w, h in got) and len(set(known.values())) == len(known)


def test_folded_words():
    long = b"Q" * 70
    (a, b, c, d, e, f) = (h for *_, h in parsed([b"Abc abC zz" + long + b" ZZ" + long.lower() + " É é".encode()], fold=True))
    assert a == b and c == d and e != f


def test_short_words_take_no_step_for_each_byte(monkeypatch):
    steps = []
    powers = tokens.powers
    monkeypatch.setattr(tokens, "powers", lambda n: steps.append(n) or powers(n))
    parsed([b"some short words of a text " * 4000])
    assert steps == []
    parsed([b"some short words " * 40 + b"l" * 500 + b" and more " * 4000])
    assert sum(steps) < 2000
