"""SentencePiece by the prefix table and cross-tokenizer alignment against the libraries."""

import hashlib
import random
from collections import Counter
from itertools import accumulate

import pytest

from riskloom.llm import align, pieces
from riskloom.llm.catalog import tokenizer_path

from .cases import documents, frame

MODEL = tokenizer_path("piece_bpe_32k.model")
BYTES = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(MODEL)


def awkward(model, rng):
    yield from ["", " ", "▁", "▁▁ ▁", "a▁ b", "a\0b <s> </s> <0x41> <unk>", "日本語 テスト 😀😀", "\n\n\t x\r\n"]
    yield from (" " * k + "x" * (k % 3) for k in range(50))
    for _ in range(4000):
        yield "".join(rng.choice(" ab▁ etaoin shrdlu\n12é日") for _ in range(rng.randrange(1, 30)))
    for _ in range(800):
        yield "".join(rng.choice("aab ") for _ in range(rng.randrange(1, 80)))
    for _ in range(800):
        yield "".join(rng.choice([model.names[rng.randrange(259, 32000)].replace("▁", " "), chr(rng.randrange(32, 0xD7FF))]) for _ in range(rng.randrange(1, 8)))


def test_pieces_equal_the_library(model, library):
    for text in awkward(model, random.Random(1)):
        ids = library.encode(text, add_eos=True)
        assert model.encode(text) == ids, text
        assert model.decode(ids) == library.decode(ids), text


def test_decoding_any_ids_equals_the_library(model, library):
    rng = random.Random(2)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(3), rng.randrange(3, 259), rng.randrange(128, 259), rng.randrange(259, 32000), 28705]) for _ in range(rng.randrange(12))]
        assert model.decode(ids) == library.decode(ids), ids


def test_pair_results_kept_per_token_and_forgotten(monkeypatch, library):
    monkeypatch.setattr(pieces, "PAIR_CACHE", 20)
    own = pieces.PieceModel(MODEL)
    for text in awkward(own, random.Random(3)):
        ids = own.encode(text)
        assert ids == library.encode(text, add_eos=True), text
        kept = sum(map(len, own.fits.values()))
        assert kept == own.tested <= 20 + 4 * len(text) ** 2 + 4
        plain = [i for i in ids if own.texts[i] is not None]
        assert own.surface(plain) == "".join(own.names[i].replace("▁", " ") for i in plain)


def test_pair_test_equals_merging_the_pair(model):
    def merged(text):
        """Plain merging: the best pair, leftmost first, until none is left."""
        row = [model.symbols[c] for c in text]
        while True:
            found = [(model.joined[a * model.width + b], k) for k, (a, b) in enumerate(zip(row, row[1:])) if a * model.width + b in model.joined]
            if not found:
                return row
            (_, made), k = min(found, key=lambda x: (x[0][0], x[1]))
            row[k : k + 2] = [made]

    rng = random.Random(3)
    tokens = list(model.steps)
    short = [t for t in tokens if model.length[t] <= 2]
    for pool in (tokens, short):
        for _ in range(4000):
            one, two = rng.choice(pool), rng.choice(pool)
            assert model.compatible(one, two) == (merged(model.names[one] + model.names[two]) == [one, two])


def test_round_trip_of_documents(spark, library):
    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    want = []
    for doc_id, text, *_ in documents():
        ids = library.encode(text or "", add_eos=True)
        want.append((doc_id, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids))))
    got = [tuple(r) for r in pieces.round_trip(frame(spark), MODEL).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert pieces.round_trip(frame(spark, []), MODEL).count() == 0


def test_encoded_documents_decode_to_their_texts(spark, library):
    coded = pieces.encode_documents(frame(spark), MODEL)
    texts = {(r[0], r[1]) for r in pieces.decode_documents(coded, MODEL).collect()}
    assert texts == {(i, library.decode(library.encode(t or ""))) for i, t, *_ in documents()}
    assert sorted(map(tuple, (r.ids for r in coded.collect()))) == sorted(tuple(library.encode(t or "", add_eos=True)) for _, t, *_ in documents())


def test_units_remembered_change_nothing(monkeypatch, model):
    text = "the quick brown fox " * 50 + "jumps"
    whole = model.encode_unit("▁" + text.replace(" ", "▁"))
    monkeypatch.setattr(pieces, "UNIT_CACHE", 4)
    table = pieces.UnitIds(MODEL)
    units = [(" " + w).encode() for w in text.split(" ")]
    assert [i for u in units for i in table.of(u)] == whole


# --- alignment

def by_hand(texts, library):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, digest), from whole texts and plain loops."""
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(BYTES)
    tokenizer.encode_special_tokens = True
    letters = align.byte_letters()
    found, count = [], Counter()
    for text in texts:
        links, groups, a, b = [], [], [], []
        if text:
            a, b = tokenizer.encode(" " + text, add_special_tokens=False).ids, library.encode(text)
            a_bytes = [bytes(letters[c] for c in tokenizer.id_to_token(i)) for i in a]
            b_bytes = [bytes([int(library.id_to_piece(i)[3:5], 16)]) if library.is_byte(i) else library.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
                a_end, b_end = list(accumulate(map(len, a_bytes))), list(accumulate(map(len, b_bytes)))
                links = [(x, y) for k, x in enumerate(a) for m, y in enumerate(b)
                         if max(a_end[k] - len(a_bytes[k]), b_end[m] - len(b_bytes[m])) < min(a_end[k], b_end[m])]
                before = 0
                for end in sorted(set(a_end) & set(b_end)):
                    groups.append(",".join(str(x) for x, e in zip(a, a_end) if before < e <= end) + "|" + ",".join(str(y) for y, e in zip(b, b_end) if before < e <= end))
                    before = end
            else:
                a, b = [], []
        count.update(links)
        found.append((len(a), len(b), groups, links))
    best = Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return [(a, b, len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for a, b, groups, links in found]


def test_alignment_equals_brute_force(spark, library):
    rng = random.Random(4)
    texts = ["", None, "a", " ", "  a  b \u00a0 c \u3000 d", "x ▁ y", "<|endoftext|> z </s>", "it's  I'll\n\n  ok", "é " * 5, "日本 語  x\u0085 y", "same text", "same text"]
    texts += ["".join(rng.choice(" ab's\n\t 12é日.,! x") for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    texts += [t for _, t, *_ in documents() if len(t or "") < 500]
    rows = [(k if k % 7 else None, t, "en", "a") for k, t in enumerate(texts)]
    got = [tuple(r) for r in align.align_documents(frame(spark, rows).repartition(3), BYTES, MODEL).collect()]
    assert sorted(got, key=str) == sorted(((r[0], *x) for r, x in zip(rows, by_hand(texts, library))), key=str)
    assert align.align_documents(frame(spark, []), BYTES, MODEL).count() == 0


def test_alignment_does_not_depend_on_blocks(spark, monkeypatch):
    one = sorted(map(str, align.align_documents(frame(spark), BYTES, MODEL).collect()))
    monkeypatch.setattr(align, "BLOCK", 300)
    assert sorted(map(str, align.align_documents(frame(spark), BYTES, MODEL).collect())) == one


def test_units_of_a_few_blocks_ago_are_not_encoded_again():
    class Counted(align.Remembered):
        calls = 0

        def encoded(self, units):
            self.calls += len(units)
            return [[int(u), 7] if int(u) % 3 else [] for u in units]
    memory, size = Counted(), 80_000  # about the distinct units of a block
    rounds = [[str(size * r + k).encode() for k in range(size)] for r in range(3)]
    for units in [*rounds, rounds[0]]:
        assert memory.of_all(units).to_pylist() == [[int(u), 7] if int(u) % 3 else [] for u in units]
    assert memory.calls == 3 * size
