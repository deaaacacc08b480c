"""Networks see all the words that their widths promise."""

from types import SimpleNamespace

import numpy as np
import pytest

from tonewright.plans import features, models
from tonewright.operators import nets


@pytest.fixture(scope="module")
def tables(spark):
    word = lambda k: "w" + "".join(chr(97 + int(c)) for c in str(k))
    long = " ".join(word(k % 70) for k in range(1200)) + " " + word(70)
    rows = [(1, 0, "user", " ".join(map(word, range(70)))), (1, 1, "assistant", ""), (2, 0, "user", long)]
    vecs = [(k, [float(k + 1)] * 64) for k in range(40)]
    return SimpleNamespace(conversations=spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), embeddings=spark.createDataFrame(vecs, "vec_id long, embedding array<float>"))


def test_matrices_have_56_words(tables):
    rank = {r["word"]: r["rank"] for r in features.vocabulary(tables).collect()}
    words = tables.conversations.where("conv_id = 1 and turn = 0").first()["text"].split()
    got = {(r.conv_id, r.turn): r.ids for r in features.matrix_ids(tables).collect()}
    assert got[1, 0] == [rank[w] + 1 if rank[w] <= 40 else 1 for w in words[:56]]
    assert got[1, 1] == [0] * 56
    table = features.vector_table(tables, (0.1, 0.01), 0.01)
    assert table[:, 0].tolist()[:4] == [0.1, 0.01, 1.0, 2.0] and table[-1, 0] == 0.01


def test_sequences_have_the_last_1000_words(tables):
    rank = {r["word"]: r["rank"] for r in features.vocabulary(tables).collect()}
    words = tables.conversations.where("conv_id = 2").first()["text"].split()
    got = {(r.conv_id, r.turn): r.ids for r in features.sequence_ids(tables).collect()}
    assert got[2, 0] == [rank[w] for w in words[-1000:]]
    assert got[1, 0][:930] == [0] * 930 and 0 not in got[1, 0][930:] and got[1, 1] == [0] * 1000


@pytest.mark.parametrize("name, shape", [("dense_predict", (56, 64)), ("cnn_predict", (56, 64, 1)), ("cnn_deep_predict", (56, 64, 1)), ("lstm_predict", (1000, 64))])
def test_networks_are_as_wide(tables, monkeypatch, name, shape):
    seen = []
    monkeypatch.setattr(nets, "fit_predict", lambda train, test, key, width, net, **named: seen.append((width, net)))
    getattr(models, name)(tables)
    (width, net), = seen
    x = net.layers[0].forward(np.zeros((2, *width)), None)
    assert x.shape == (2, *shape) and net.probabilities(np.zeros((2, *width))).shape == (2, 2)


@pytest.mark.parametrize("name", ["dense_predict", "cnn_predict", "cnn_deep_predict", "lstm_predict"])
def test_networks_learn_from_as_many_rows_as_stated(tables, monkeypatch, name):
    seen = []
    monkeypatch.setattr(nets, "fit_predict", lambda *rest, most=20_000, **named: seen.append(most))
    getattr(models, name)(tables)
    assert seen == [20_000]


def test_word_index_sequences_keep_the_last_1000_known_words(tables):
    rank = {r["word"]: r["rank"] for r in features.vocabulary(tables).collect()}
    words = tables.conversations.where("conv_id = 2").first()["text"].split()
    got = {(r.conv_id, r.turn): r for r in features.word_index_sequences(tables).collect()}
    assert got[2, 0].words == 1000 and got[2, 0].ids == " ".join(str(rank[w]) for w in words[-1000:])
