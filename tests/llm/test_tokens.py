import json
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from obsidia.llm import pretokens
from obsidia.llm.packing import CAPACITY, END, pack_documents, packing_plan, plan_slots
from obsidia.llm.pretokens import pieces
from obsidia.llm.queries import op1_token_counts, op10_best_fit_packing
from obsidia.llm.token_counts import token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(PATH)


def plain_ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


def packed_ids(text):
    return np.frombuffer(pieces(PATH).packed(text), "<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(list("aAéÉ'sdre.,!? \n\t\x1c\x85\xa0 ́ß1½µσΣİ<|>"))), max_size=60))
def test_any_text_has_the_tokenizers_ids(text):
    assert packed_ids(text) == plain_ids(text)


@pytest.mark.parametrize("text", ["<|endoftext|>", "a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|><|endoftext|>", "don't WE'LL 's 'S rock'n'roll", "x" * 3000, "́ á Å ﬁ", "²³¼ ½a", "a b\x85c\xa0d"])
def test_odd_texts(text):
    assert packed_ids(text) == plain_ids(text)


def test_counts_match_the_tokenizer(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op1_token_counts(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = len(plain_ids(docs[r.doc_id]))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((docs[r.doc_id] or "").encode()), n > 2048)


@pytest.mark.parametrize("head", [1, 1 << 17])
def test_counts_of_odd_rows_by_either_join(odd_docs, head):
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(plain_ids(r.text))) for r in odd_docs.collect())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts(odd_docs, PATH, head=head).collect()) == want


def test_empty_table(no_docs):
    assert token_counts(no_docs, PATH).count() == 0
    assert pack_documents(no_docs, PATH).count() == 0


def check_packing(docs, rows, capacity=CAPACITY):
    """docs: (id, text) rows; every piece is there, crcs hold, sequences are gapless and within capacity."""
    want = []
    for i, text in docs:
        ids = [*plain_ids(text), END]
        for k, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at : at + capacity]
            want.append((str(i), k, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held), sum(w[3] for w in want)


def test_packing_of_the_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    used, tokens = check_packing(docs, op10_best_fit_packing(spark, sf_dir).collect())
    assert used <= -(-tokens // CAPACITY) + 1


def test_packing_of_odd_rows(odd_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    check_packing(docs, pack_documents(odd_docs, PATH, capacity=64).collect(), 64)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=20))
def test_plans_use_every_piece_once(available):
    plan = packing_plan(available, 40)
    used = defaultdict(int)
    for pattern, n in plan:
        assert n > 0 and sum(pattern) <= 40
        for length in pattern:
            used[length] += n
    assert used == available
    slots = plan_slots(plan)
    assert all(np.diff(slots["length"] * 10**6 + slots["first"]) > 0)


def test_exact_complements_are_found():
    assert sorted(packing_plan({7: 2, 3: 2, 5: 3, 1: 2, 4: 1}, 10), key=str) == sorted([((7, 3), 2), ((5, 5), 1), ((5, 4, 1), 1), ((1,), 1)], key=str)
    plan = packing_plan({6: 5, 2: 5, 1: 10}, 10)
    assert plan[:2] == [((6, 2, 2), 2), ((6, 2, 1, 1), 1)] and sum(n for _, n in plan) == 5


def test_plans_of_many_lengths_stay_near_the_bound():
    rng = np.random.default_rng(3)
    lengths = np.minimum(rng.lognormal(6.2, 1.0, 60_000).astype(int) + 1, CAPACITY)
    available = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
    used = sum(n for _, n in packing_plan(available))
    assert used <= 1.002 * -(-int(lengths.sum()) // CAPACITY)


def test_vocabularies_that_treat_texts_otherwise(tmp_path):
    """Another normaliser or pattern: ids are those of the library all the same."""
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        said = json.load(f)
    assert pretokens.splits_alike(public_tokenizers.path("word_bpe_49k.json"))
    said["normalizer"]["normalizers"].pop()
    path = tmp_path / "other.json"
    path.write_text(json.dumps(said), encoding="utf-8")
    made, library = pretokens.Pieces(str(path)), Tokenizer.from_file(str(path))
    assert not made.alike
    for text in ("The Quick brown FOX, 3.14 and <|endoftext|> more", "", "ÉCOLE école " * 50):
        ids = library.encode(text, add_special_tokens=False).ids
        assert made.packed(text) == b"".join(i.to_bytes(4, "little") for i in ids)
