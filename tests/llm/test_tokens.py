"""Encoding, token files, packing and piece counts: exact round trips and direct versions."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from edge_cases import edge_docs, no_docs  # noqa: F401
from tokenizers import Tokenizer

from codescope.llm import encoding, packing, tokencount, tokenfile
from codescope.llm.shared import written
from codescope.session import scratch_path


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(encoding.default_path())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def test_encoder_equals_the_tokenizer(tokenizer):
    random.seed(8)
    letters = [*"ab'.,1é%\n\t", " ", "　", "\x1c", "<|endoftext|>", "ж", "漢", "Ġ", "Ċ", *" " * 6]
    texts = ["", " ", "\n", "a\n", "\na", " a b ", "it's 'd", "a \n b", "a\r\nb"]
    texts += ["".join(random.choice(letters) for _ in range(random.randint(0, 40))) for _ in range(3000)]
    encoder = encoding.WordEncoder(encoding.default_path(), limit=50)
    for _ in range(2):
        found = [np.frombuffer(x, encoding.ID).tolist() for i in range(0, len(texts), 100) for x in encoder.encode(texts[i : i + 100])]
        assert found == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_with_signs_behind_them_are_learned_once(tokenizer):
    """A word before signs is looked up like any other: the library sees it and the signs once."""
    endings = ["", ".", ",", "###", "$$$", "%%%", "&&&", ",!!", "!?", "'s,", "-", "1,", "…"]
    texts = [" ".join(w + e for w in ("orble", "éçle", "Ждать", "漢字", "it's", "x2", "²")) for e in endings]
    encoder = encoding.WordEncoder(encoding.default_path())
    seen, learn = [], encoder._learn_by
    encoder._learn_by = lambda tokenizer, words, *rest: (seen.extend(words), learn(tokenizer, words, *rest))
    found = [np.frombuffer(x, encoding.ID).tolist() for x in encoder.encode(texts)]
    assert found == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert "éçle" in seen and not {"éçle###", "éçle$$$", "éçle,!!"} & set(seen)


def test_remembered_words_are_bounded():
    """A worker keeps what it remembers while other stages run."""
    encoder = encoding.WordEncoder(encoding.default_path())
    digits = str.maketrans("0123456789", "abcdefghij")
    for i in range(100_000, 420_000, 20_000):
        encoder.encode([" ".join(str(k).translate(digits) for k in range(i, i + 20_000))])
    assert len(encoder.young) + len(encoder.old) < 250_000


def test_slices_hold_few_bytes_and_all_rows():
    for size, n in ((10, 10_000), (1 << 16, 1000), (0, 5)):
        batch = pa.RecordBatch.from_pydict({"text": ["x" * size] * n})
        parts = list(encoding.slices(batch))
        assert sum(p.num_rows for p in parts) == n and max(p.num_rows for p in parts) <= encoding.TEXTS_AT_ONCE
        assert max(p.num_rows for p in parts) * size <= encoding.BYTES_AT_ONCE
    assert list(encoding.slices(batch.slice(0, 0))) == []


# --- token files --------------------------------------------------------------------


def test_grammar_round_trip():
    rng = np.random.default_rng(1)
    cases = [np.zeros(0), np.zeros(1), np.full(5000, 7), np.tile([1, 2, 3], 3000), rng.zipf(1.3, 50_000) % 3000, np.tile([5, 5, 5, 6], 2000)]
    for case in cases:
        ids = case.astype(encoding.ID)
        base, rules, sizes, seq = tokenfile.compress(ids)
        assert (tokenfile.decode(base, rules, seq) == ids).all()
        assert len(rules) == len(sizes) and all(a < base + k and b < base + k for k, (a, b) in enumerate(rules.tolist()))
        for _ in range(20):
            a, b = sorted(rng.integers(0, len(ids) + 1, 2).tolist())
            if len(ids):
                assert (tokenfile.decode_range(base, rules, sizes, seq, a, b) == ids[a:b]).all()
    base, rules, _, seq = tokenfile.compress(np.tile(np.arange(4, dtype=encoding.ID), 4096))
    assert len(rules) >= 3 and len(seq) < 5000


def test_token_file_of_edge_rows(spark, tokenizer, edge_docs, no_docs):
    path = scratch_path(spark, "test")
    tokenfile.write(tokenfile.encode(edge_docs, shard_tokens=20), path)
    found = tokenfile.read(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == [None, None, 1, 1, 2, 3, 4, 5, 6]
    texts = sorted(((r["doc_id"] or 0, r["text"] or "") for r in edge_docs.collect()))
    at = 0
    for r, (_, text) in zip(found, texts):
        expected = ids_of(tokenizer, text)
        assert (r["start"], r["n_tokens"], np.frombuffer(r["ids"], encoding.ID).tolist()) == (at, len(expected), expected)
        at += len(expected)
    tokenfile.write(tokenfile.encode(no_docs), path + "-none")
    assert tokenfile.read(spark, path + "-none").count() == 0


def test_no_pair_that_pays_is_left():
    """Pairs of symbols beyond the thousand most frequent, and late rounds of little gain."""
    rng = np.random.default_rng(8)
    phrases = rng.integers(0, 6000, (3000, 5)).astype(encoding.ID)
    ids = phrases[rng.integers(0, 3000, 20_000)].ravel()
    base, rules, _, seq = tokenfile.compress(ids)
    assert (tokenfile.decode(base, rules, seq) == ids).all()
    _, counts = np.unique(seq[:-1].astype(np.int64) << 32 | seq[1:], return_counts=True)
    assert counts.max() < tokenfile.MIN_COUNT


def test_later_rounds_look_at_new_symbols_only(monkeypatch):
    """No pair of two earlier symbols is left or made, so only places of new ones are counted."""
    places, count = [], tokenfile._frequent_pairs
    monkeypatch.setattr(tokenfile, "_frequent_pairs", lambda *given: (places.append(len((found := count(*given))[2])), found)[1])
    rng = np.random.default_rng(3)
    filler, phrase = rng.permutation(60_000).astype(encoding.ID) % 1000, np.arange(2000, 2008, dtype=encoding.ID)
    ids = np.concatenate([np.concatenate((filler[i : i + 600], phrase)) for i in range(0, 60_000, 600)])
    base, rules, _, seq = tokenfile.compress(ids)
    assert (tokenfile.decode(base, rules, seq) == ids).all() and len(rules) >= 7
    assert len(places) > 2 and max(places[1:]) < len(ids) / 50


def test_documents_by_id(spark, tokenizer, edge_docs):
    path = scratch_path(spark, "test-some")
    tokenfile.write(tokenfile.encode(edge_docs, shard_tokens=20), path)
    found = sorted((r["doc_id"], r["n_tokens"], bytes(r["ids"])) for r in tokenfile.read_documents(spark, path, [1, 5, 77]).collect())
    whole = tokenfile.read(spark, path).where("doc_id IN (1, 5)").collect()
    assert found == sorted((r["doc_id"], r["n_tokens"], bytes(r["ids"])) for r in whole) and len(found) == 3


# --- packing ------------------------------------------------------------------------


def test_pieces_fill_sequences_exactly():
    random.seed(2)
    for capacity in (16, 1024):
        lengths = [random.choice([1, 2, random.randint(1, 3 * capacity)]) for _ in range(random.randint(1, 300))]
        pieces = packing.assign(lengths, capacity)
        of_doc, of_sequence = {}, {}
        for doc, start, n, s, offset in pieces:
            of_doc.setdefault(doc, []).append((start, n))
            of_sequence.setdefault(s, []).append((offset, n))
        for held, totals in ((of_doc, dict(enumerate(lengths))), (of_sequence, dict(enumerate(packing.sequence_sizes(sum(lengths), capacity))))):
            assert set(held) == set(totals)
            for k, parts in held.items():
                at = 0
                for a, n in sorted(parts):
                    assert a == at and n > 0
                    at += n
                assert at == totals[k]
        for size in packing.sequence_sizes(sum(lengths), capacity):
            assert size == capacity or size & (size - 1) == 0


def test_cheapest_sequence_with_room_comes_first():
    # Two sequences; the long document makes its own dear, so the short ones go to the other.
    pieces = packing.assign([10, 6, 5, 4, 4, 3], 16, quadratic=1.0)
    place = {doc: s for doc, _, _, s, _ in pieces}
    assert place[0] != place[1] and place[1] == place[2] == place[3]


def test_pack_edge_rows(tokenizer, edge_docs, no_docs):
    found = written(packing.pack(edge_docs, group_tokens=1000), "pieces").collect()
    by_doc = {}
    for r in found:
        ids = np.frombuffer(r["ids"], encoding.ID).tolist()
        assert len(ids) == r["length"]
        by_doc.setdefault(r["doc_id"], []).append((r["start"], ids, r["doc_tokens"]))
    texts = {r["doc_id"]: r["text"] for r in edge_docs.collect()}
    for i in (2, 3, 4, 5, 6):
        whole = [x for _, ids, _ in sorted(by_doc[i]) for x in ids]
        assert whole == ids_of(tokenizer, texts[i]) and {n for *_, n in by_doc[i]} == {len(whole)}
    assert sum(n for s, ids, n in by_doc[1] if s == 0) == 2 * len(ids_of(tokenizer, texts[1]))
    assert sum(s == 0 for s, *_ in by_doc[None]) == 2
    assert packing.pack(no_docs).count() == 0


# --- piece counts -------------------------------------------------------------------


def greedy(first, later, word):
    i, n = 0, 0
    while i < len(word):
        pieces = later if i else first
        j = next((j for j in range(len(word), i, -1) if word[i:j] in pieces), 0)
        if not j:
            return 1
        i, n = j, n + 1
    return n


def test_automaton_equals_greedy_splitting():
    random.seed(6)
    some = lambda: {"".join(random.choice("abc") for _ in range(random.randint(1, 4))) for _ in range(random.randint(1, 9))}
    for _ in range(400):
        first, later = some(), some()
        automaton = tokencount.Automaton(first, later)
        for _ in range(20):
            word = "".join(random.choice("abc") for _ in range(random.randint(0, 10)))
            assert automaton.count(word) == greedy(first, later, word), (first, later, word)


def test_counts_of_edge_rows(edge_docs, no_docs):
    pieces, _ = tokencount.word_end_vocabulary(tokencount.default_path())
    letters = encoding.BYTE_LETTERS
    known = {r["doc_id"]: (r["text"], r["tokens"]) for r in tokencount.with_counts(edge_docs).collect() if r["doc_id"]}
    for text, found in known.values():
        words = tokencount.WORD.findall((text or "").lower())[:3000]
        expected = sum(greedy(pieces, pieces, "".join(letters[b] for b in w.encode()) + "\n") for w in words)
        if text is None or len(text) < 3000:
            assert tuple(found) == (len(words), expected)
    assert known[5][1]["n_words"] > 60_000
    assert tokencount.with_counts(no_docs).count() == 0


def test_crc_of_a_piece(spark):
    ids = np.arange(5, dtype=encoding.ID).tobytes()
    assert spark.createDataFrame([(ids,)], "ids binary").selectExpr("crc32(ids) AS c").first()["c"] == zlib.crc32(ids)
