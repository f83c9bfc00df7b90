"""Encoding, packing and toxicity: against libraries, plain versions, and held-out labels."""

import random

import numpy as np
import pytest

pytest.importorskip("spanlight.llm")

from spanlight.llm import bpe, packing, queries, toxicity  # noqa: E402

HARD = ["", " ", "a" * 5000, "ab" * 3000, "​" * 50, "日本語" * 300, " " * 3000 + "x", "0" * 3001, "don't <|endoftext|> stop\r\n\tx", "é" * 700 + "\U0001f621"]


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{bpe.TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_trie_encoder_equals_the_library(library):
    rng = random.Random(5)
    encoder = bpe.TrieEncoder(bpe.load_ranks(f"{bpe.TOKENIZER_DIR}/byte_bpe_50k.tiktoken"), cache=50)
    texts = HARD + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FFF)])) for _ in range(rng.randrange(1, 300))) for _ in range(150)]
    for text in texts:  # the small cache makes it start afresh again and again
        assert encoder.encode(text) == library(text)
        assert encoder.count(text) == len(library(text))


def test_stable_pairs_equal_plain_merging():
    encoder = bpe.TrieEncoder(bpe.load_ranks(f"{bpe.TOKENIZER_DIR}/byte_bpe_50k.tiktoken"))
    rng = random.Random(6)
    for _ in range(1500):
        left, right = rng.randrange(50_000), rng.randrange(50_000)
        assert encoder.is_stable(left, right) == (encoder.merge(encoder.bytes_of[left] + encoder.bytes_of[right]) == [left, right])


def test_p6_ids_whole_table(spark, sf, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r.ids for r in queries.p6_ids(spark, sf).collect()}
    assert got == {d: library(t) if t else [] for d, t in texts.items()}


def test_encode_nulls_empty_tables_and_extra_columns(spark):
    df = spark.createDataFrame([("a", None, 1), ("b", "", 2), ("c", "hi", 3), ("c", "hi", 3)], "k string, text string, ids int")
    assert sorted((r.k, r.ids) for r in bpe.encode_corpus(df, "k", "text").collect()) == [("a", []), ("b", []), ("c", [5303]), ("c", [5303])]
    assert bpe.encode_corpus(df.where("false"), "k", "text").count() == 0
    assert sorted(r.n_tokens for r in bpe.count_tokens(df, "k", "text").collect()) == [0, 0, 1, 1]


def check_packing(sizes, capacity, patterns):
    left = dict(sizes)
    for pattern, times in patterns:
        assert times > 0 and sum(pattern) <= capacity
        for s in pattern:
            left[s] -= times
    assert not any(left.values())
    return sum(t for _, t in patterns)


@pytest.mark.parametrize("seed", range(6))
def test_best_two_fit_packs_everything_tightly(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 97, 512])
    sizes: dict[int, int] = {}
    for _ in range(rng.choice([1, 50, 3000])):
        s = min(capacity, 1 + int(rng.expovariate(4 / capacity)))
        sizes[s] = sizes.get(s, 0) + 1
    bins = check_packing(sizes, capacity, packing.best_two_fit(sizes, capacity))
    # plain first-fit decreasing is no better
    room: list[int] = []
    for s in sorted((s for s, n in sizes.items() for _ in range(n)), reverse=True):
        for i, free in enumerate(room):
            if free >= s:
                room[i] -= s
                break
        else:
            room.append(capacity - s)
    assert bins <= len(room) * 1.01 + 1


def test_best_two_fit_swaps_the_smallest_for_two():
    # greedily 6 + 3 leaves a gap of 1; 2 + 2 fill it exactly
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)[0][0] == [6, 2, 2]


def test_best_two_fit_edges():
    assert packing.best_two_fit({}, 5) == []
    assert packing.best_two_fit({5: 3}, 5) == [([5], 3)]
    with pytest.raises(ValueError):
        packing.best_two_fit({6: 1}, 5)


def test_pack_splits_only_oversized_rows(spark):
    df = spark.createDataFrame([(1, 25), (2, 10), (3, 4), (4, 0), (5, None), (6, 6), (7, 6)], "k long, n long")
    rows = packing.pack(df, "k", "n", 10).collect()
    used: dict[int, int] = {}
    for r in rows:
        used[r.container_id] = used.get(r.container_id, 0) + r["size"]
    assert max(used.values()) <= 10 and sorted(used) == list(range(len(used)))
    assert sorted((r.k, r.piece, r.start, r["size"]) for r in rows) == [(1, 0, 0, 10), (1, 1, 10, 10), (1, 2, 20, 5), (2, 0, 0, 10), (3, 0, 0, 4), (4, 0, 0, 0), (5, 0, 0, 0), (6, 0, 0, 6), (7, 0, 0, 6)]
    assert packing.pack(df.where("false"), "k", "n", 10).count() == 0
    assert {r.container_id for r in packing.pack(df.where("k = 4"), "k", "n", 10).collect()} == {0}


def test_p7_whole_table(spark, sf):
    fill = {r.budget_id: r for r in queries.p7_fill(spark, sf).collect()}
    for r in fill.values():
        assert r.fullest <= r.capacity_tokens and r.n_containers >= r.least_containers
        assert r.n_containers <= r.least_containers * 1.02 + 1
    rows = queries.p7_assignments(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert {r["count"] for r in rows.select("budget_id", "doc_id").distinct().groupBy("budget_id").count().collect()} == {docs}


INSULTS = ["you are a complete idiot", "only a wanker trusts this", "shut up you filthy parasite", "du bist ein Vollidiot", "eres un gilipollas", "send me nudes you slut"]
CLEAN = ["the process was killed by the agent", "the backup ran at night", "we saw a beacon to the host", "der Server wurde neu gestartet", "la regla se activó dos veces", "le trafic a cessé"]


def sample(rng, n):
    texts, labels = [], []
    for _ in range(n):
        own = [rng.choice(CLEAN) for _ in range(rng.randrange(1, 5))]
        toxic = rng.random() < 0.3
        if toxic:
            own.insert(rng.randrange(len(own) + 1), rng.choice(INSULTS))
        texts.append(". ".join(own) + ".")
        labels.append(float(toxic if rng.random() > 0.08 else not toxic))
    return texts, labels


def scores(chain, segments):
    opening = chain.openings()
    return chain.score_columns([toxicity.known_columns(tokens, opening) for tokens in segments])


def test_known_columns_are_the_known_features():
    rng = random.Random(3)
    words = ["a", "b", "c", "d"]
    names = sorted({f for _ in range(12) for f in toxicity.features([rng.choice(words) for _ in range(3)])})
    chain = toxicity.Chain({f: i for i, f in enumerate(names)}, np.zeros((len(names), 5)), np.zeros((5, 5)), np.zeros(5), 0.5)
    for _ in range(200):
        tokens = [rng.choice([*words, "z"]) for _ in range(rng.randrange(0, 7))]
        assert sorted(toxicity.known_columns(tokens, chain.openings())) == sorted(chain.index[f] for f in toxicity.features(tokens) if f in chain.index)


def test_categories_spread_beyond_the_seed_words():
    """Toxic segments without any seed word get the category of those that share their other words."""
    hits = np.zeros((6, 2), bool)
    hits[0, 0] = hits[1, 1] = True
    x = toxicity.Rows([[0, 2], [1, 3], [2, 4], [3, 5], [4], []], 6)
    share = toxicity.category_shares(x, np.ones(6), hits, np.array([0, 1]))
    assert share[2, 0] > 0.6 and share[3, 1] > 0.6 and share[4, 0] > 0.5 and np.allclose(share[5], 0.5)


def test_held_out_scores_do_not_need_the_seed_words():
    texts, labels = sample(random.Random(2), 800)
    for weight in (toxicity.SEED_WEIGHT, 0.0):
        held: list[float] = []
        chain = toxicity.train(texts, labels, seed_weight=weight, held_out=held)
        truth = np.array([any(i in t for i in INSULTS) for t in texts])
        got = np.array(held) >= chain.threshold
        assert (got & truth).sum() / truth.sum() >= 0.9 and (got & truth).sum() / got.sum() >= 0.9


def test_chain_learns_from_noisy_document_labels():
    chain = toxicity.train(*sample(random.Random(1), 600))
    cut = toxicity.Segmenter()
    for text in CLEAN:
        assert scores(chain, cut.segments(text))[:, 4].max() < chain.threshold, text
    for text in [*INSULTS, "you are a complete 1d10t", "you are a complete i d i o t", "ѕhut up you fіlthy раrаѕіte", "shut up you filthyyy para​site", "GET http://x.test/?q=you+are+a+complete+idiot"]:
        assert scores(chain, cut.segments("the backup ran at night.\n" + text))[:, 4].max() >= chain.threshold, text


def test_untrained_chain_uses_seed_words():
    chain = toxicity.train([], [])
    cut = toxicity.Segmenter()
    assert scores(chain, cut.segments("you worthless moron, you idiot"))[:, 4].max() >= chain.threshold
    assert scores(chain, cut.segments("the backup ran at night"))[:, 4].max() < chain.threshold


def test_scores_of_empty_texts_and_tables(spark):
    chain = toxicity.train([], [])
    df = spark.createDataFrame([(1, None), (2, ""), (3, "  "), (4, "x" * 300_000), (5, "idiot moron wanker")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score_documents(df, chain).collect()}
    assert [got[i].score for i in (1, 2, 3)] == [0, 0, 0] and not got[4].flagged and got[5].flagged
    assert toxicity.score_documents(df.where("false"), chain).count() == 0


def test_labelled_sample_is_bounded_and_skips_abstentions(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(20)] + [(99, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, "r") for i in range(20)] + [(1, 0, "q"), (2, None, "q"), (99, 1, "r")], "doc_id long, toxic int, reviewer string")
    texts, verdicts = toxicity.labelled_sample(docs, labels)
    assert len(texts) == 20 and verdicts[1] == 0.5 and verdicts[2] == 0.0
    assert len(toxicity.labelled_sample(docs, labels, 5)[0]) <= 5


def test_held_out_accuracy(spark):
    """Trained on three quarters of the reviewed documents, judged on the rest (whose labels err as well)."""
    import os

    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("no table to judge on")
    texts, labels = toxicity.labelled_sample(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/doc_labels.parquet"))
    rest = [i for i in range(len(texts)) if i % 4 == 0]
    learn = [i for i in range(len(texts)) if i % 4]
    chain, cut = toxicity.train([texts[i] for i in learn], [labels[i] for i in learn]), toxicity.Segmenter()
    right = 0
    for i in rest:
        own = cut.segments(texts[i])
        right += bool(own and scores(chain, own)[:, 4].max() >= chain.threshold) == (labels[i] > 0.5)
    assert right / len(rest) >= 0.8
