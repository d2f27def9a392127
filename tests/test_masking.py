"""Infilling and gap sentences with given draws and scores."""

import pytest

from emberlog.operators.masking import Draws, GapSentences, TextInfilling, count_to_mask

TEN = [list(range(10))]
THREE = [[0, 1, 2], [3, 4, 5], [6, 7, 8, 9]]
SHORT = [[0, 1], [2, 3], [4]]

# Sentences, result, lengths, positions.
MASKED = [
    (TEN, [[0, 1, 2, 3, -1, 7, 8, 9]], (3,), (4,)),
    (TEN, [[0, 1, 2, 3, -1, 5, 6, 7, -1, 9]], (1, 1), (4, 8)),
    (TEN, [[0, -1, -1, 7, 8, 9]], (3, 3), (1, 1)),
    (TEN, [[0, 1, 2, 3, -1, 7, -1, 9]], (3, 1), (4, 8)),
    (TEN, [[0, -1, -1, -1, 5, 6, 7, 8, 9]], (3, 0, 1), (1, 1, 1)),
    (THREE, [[0, 1, 2], [3, -1], [7, -1, 9]], (3, 1), (5, 10)),
    (THREE, [[0, -1, 1, 2], [3, -1], [7, -1, 9]], (3, 0, 1), (5, 1, 10)),
    (SHORT, [[-1, 1], [2, 3], [-1]], (1, 1), (0, 7)),
    (SHORT, [[0, -1], [-1], [4]], (2, 1), (3, 1)),
    (SHORT, [[-1, -1, 1], [-1, 2, -1], [4]], (1, 0, 0, 1), (0, 0, 3, 4)),
]
SHOWN = [
    (TEN, [[-1, -1, -1, -1, 4, 5, 6, -1, -1, -1]], (3,), (4,)),
    (TEN, [[-1, 1, 2, 3, 4, 5, 6, -1, -1, -1]], (3, 3), (1, 1)),
    (THREE, [[-1, -1, -1], [-1, 4, 5], [6, -1, 8, -1]], (3, 1), (5, 10)),
    (SHORT, [[0, -1], [-1, 3], [-1]], (1, 0, 0, 1), (0, 0, 3, 4)),
]


def _infilling(sentences, lengths):
    return TextInfilling(sum(lengths) / sum(map(len, sentences)), mask_token=-1)


@pytest.mark.parametrize("sentences, expected, lengths, positions", MASKED)
def test_infilling(sentences, expected, lengths, positions):
    assert _infilling(sentences, lengths).mask(sentences, Draws(lengths=lengths, positions=positions)) == expected


@pytest.mark.parametrize("sentences, expected, lengths, positions", SHOWN)
def test_infilling_shows(sentences, expected, lengths, positions):
    assert _infilling(sentences, lengths).antimask(sentences, Draws(lengths=lengths, positions=positions)) == expected


def test_infilling_of_nothing_and_same_seed():
    assert TextInfilling().mask([]) == []
    assert TextInfilling().mask([[], []]) == [[], []]
    assert TextInfilling(0.5, seed=3).mask(THREE) == TextInfilling(0.5, seed=3).mask(THREE)


def test_gap_sentences():
    same = [["a", "b"]] * 3
    assert GapSentences().mask(same) == [["<*>"], ["a", "b"], ["a", "b"]]
    assert GapSentences().mask([[], [], []]) == [["<*>"], [], []]
    assert GapSentences(select="sequential").mask([[], [], []]) == [[], [], ["<*>"]]
    assert GapSentences(context=False).antimask(same) == [["a", "b"], ["<*>", "<*>"], ["<*>", "<*>"]]
    assert count_to_mask(5, 0.5) == 2


def test_running_counts_pick_as_plain_scores():
    import random

    from emberlog.operators.masking import unigram_f1

    rng = random.Random(2)
    for _ in range(60):
        sentences = [[rng.choice("abcdef") for _ in range(rng.randint(0, 5))] for _ in range(rng.randint(1, 9))]
        plain = GapSentences(0.5, "sequential", score=lambda a, b: unigram_f1(a, b))
        assert plain.chosen(sentences) == GapSentences(0.5, "sequential").chosen(sentences)
