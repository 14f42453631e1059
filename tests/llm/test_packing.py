import random
import zlib

import numpy as np
import pytest
from floodstats.llm import packing


def check(rows, capacity=2048):
    """Sequences are gapless from 0 and no longer than capacity; gives their number."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pieces_and_places(docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack_documents(docs).collect()
    n = check(rows)
    total, by = 0, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == set(texts)
    for i, text in texts.items():
        ids = np.array([*whole.encode(text, add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        at = 0
        for k, r in enumerate(sorted(by[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == 2048)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert n <= -(-total // 2048) * 1.03 + 1


def test_odd_rows(odd, nothing):
    rows = packing.pack_documents(odd).collect()
    check(rows)
    assert sum(r.doc_id == 9 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 2
    assert {(r.length, r.ids_crc32) for r in rows if r.doc_id in (3, 4)} == {(1, zlib.crc32(bytes(4)))}
    assert packing.pack_documents(nothing).count() == 0


def test_both_tokenizers_agree_where_the_fast_one_is_used():
    import public_tokenizers
    from tokenizers import Tokenizer

    whole, fast = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder()
    r = random.Random(5)
    for n in range(400):
        text = "".join(chr(r.randrange(0x250)) if r.random() < 0.5 else r.choice(" \n\t  ab1'st.") for _ in range(60))
        assert fast(text) == whole.encode(text, add_special_tokens=False).ids, text
    for code in range(0x250):
        text = f"a {chr(code)}{chr(code)} b{chr(code)}1 {chr(code)}"
        assert fast(text) == whole.encode(text, add_special_tokens=False).ids, code


def exact(sizes, capacity):
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        tried = set()
        for k, b in enumerate(bins):
            if b + sizes[i] <= capacity and b not in tried:
                tried.add(b)
                place(i + 1, [*bins[:k], b + sizes[i], *bins[k + 1 :]])
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best


def held(got, count, capacity):
    back = np.zeros(capacity + 1, int)
    for pattern, times in got.patterns:
        assert sum(s * m for s, m in pattern) <= capacity and times > 0
        for s, m in pattern:
            back[s] += m * times
    assert (back == count).all() and got.sequences == sum(t for _, t in got.patterns)


@pytest.mark.parametrize("seed", range(30))
def test_completion_against_exhaustive_search(seed):
    """Few kinds of lengths, so that fillings repeat, and many."""
    r = random.Random(seed)
    kinds = [r.randint(3, 30) for _ in range(3 + seed % 9)]
    sizes = sorted((r.choice(kinds) for _ in range(11)), reverse=True)
    count = np.bincount(sizes, minlength=41)
    got = packing.search(count, 40)
    held(got, count, 40)
    assert got.proved and got.sequences == exact(sizes, 40) >= packing.lower_bound(count, 40) == got.bound


def test_a_filling_used_less_often_than_it_could_be():
    """Using the fullest filling of the largest pieces as often as the counts allow costs a sequence here."""
    r, seen = random.Random(0), 0
    for _ in range(400):
        kinds = r.sample(range(4, 20), 4)
        sizes = sorted((r.choice(kinds) for _ in range(10)), reverse=True)
        count, c, greedy = np.bincount(sizes, minlength=31), np.bincount(sizes, minlength=31), 0
        while c.any():
            large = int(np.flatnonzero(c)[-1])
            one = c.copy()
            one[large] -= 1
            c, times, _ = packing._apply(c, large, min(packing.fillings(one, 30 - large), key=lambda f: -sum(f)))
            greedy += times
        best = exact(sizes, 30)
        seen += greedy > best
        got = packing.search(count, 30)
        assert got.sequences == best and got.proved
    assert seen


def test_every_undominated_filling_is_made():
    """What is left out is dominated: for each filling that fits there is one made that is at least as good, piece by piece."""
    from itertools import product

    r = random.Random(3)
    for _ in range(40):
        count = np.zeros(31, int)
        for s in r.sample(range(3, 16), 5):
            count[s] = r.randint(1, 2)
        sizes = np.flatnonzero(count).tolist()
        made = list(packing.fillings(count, 30))
        assert len(made) == len(set(made))

        def covers(big, small):
            """Whether the pieces of small can be dealt into those of big."""
            if not small:
                return True
            return any(covers(big[:i] + (b - small[0],) + big[i + 1 :], small[1:]) for i, b in enumerate(big) if b >= small[0])

        for pick in product(*(range(count[s] + 1) for s in sizes)):
            own = tuple(s for s, k in zip(sizes, pick) for _ in range(k))[::-1]
            if 0 < sum(own) <= 30 and len(own) <= 5:
                assert any(covers(m, own) for m in made), (own, made)


def test_the_result_says_what_is_proved():
    r = random.Random(9)
    sizes = [r.randint(350, 800) for _ in range(400)]
    count = np.bincount(sizes, minlength=2049)
    short, longer = packing.search(count, steps=2_000), packing.search(count, steps=100_000)
    held(short, count, 2048), held(longer, count, 2048)
    assert short.bound == longer.bound <= longer.sequences <= short.sequences and not (short.sequences > short.bound and short.proved)


def test_pack_reports_the_gap(odd):
    rows = packing.pack_documents(odd).collect()
    n = len({r.sequence_id for r in rows})
    count = np.bincount([r.length for r in rows], minlength=2049)
    assert {(r.over_bound, r.proved) for r in rows} == {(n - packing.lower_bound(count, 2048), True)}


def test_both_tokenizers_agree_on_every_document():
    import public_tokenizers
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    whole, fast = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder()
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist()
    texts = [t for t in texts if t is not None]
    assert len(texts) >= 9_000
    assert [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)] == [fast(t) for t in texts]
