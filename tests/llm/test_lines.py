"""Line dedup: passages are found wherever they begin, with marks or without."""

import random

import pytest

from tempora.llm import lines

RND = random.Random(6)


def words(n):
    return ["".join(RND.choice("abcdefghij") for _ in range(RND.randrange(2, 9))) for _ in range(n)]


PASSAGES = {
    "no marks": " ".join(words(60)),
    "two long sentences": " ".join(words(30)) + ". " + " ".join(words(30)) + ".",
    "short sentences": " ".join(" ".join(words(5)) + "." for _ in range(20)),
    "very short sentences": " ".join(" ".join(words(3)) + "." for _ in range(30)),
    "han": "".join(chr(RND.randrange(0x4E00, 0x9000)) + ("\u3002" if i % 17 == 16 else "") for i in range(120)),
}


@pytest.mark.parametrize("kind", PASSAGES)
@pytest.mark.parametrize("offset", [0, 1, 2, 5, 11, 40])
def test_most_of_a_passage_is_shared_at_any_offset(kind, offset):
    passage = PASSAGES[kind]
    a, b = (f"{' '.join(words(n))} {passage} {' '.join(words(7))}" for n in (23, offset))
    known = {u[-1] for u in lines.units(a)}
    at = b.index(passage)
    found = [(s, e) for s, e, _, d in lines.units(b) if d in known]
    assert all(at <= s and e <= at + len(passage) for s, e in found)
    assert sum(e - s for s, e in found) > 0.4 * len(passage)


def test_blocks_do_not_matter(monkeypatch):
    text = "\n".join(" ".join(words(RND.randrange(0, 90))) for _ in range(60)) + " tic tac" * 200 + PASSAGES["han"] + " x" * 300
    whole = list(lines.units(text))
    assert all(e <= s for (_, e, *_), (s, *_) in zip(whole, whole[1:], strict=False))
    for block in (1, 7, 50, 333):
        monkeypatch.setattr(lines, "BLOCK", block)
        assert list(lines.units(text)) == whole


def test_repeated_lines_go_whole():
    line = " ".join(words(45))
    spans = list(lines.units(f"{' '.join(words(9))}\n{line}\n{' '.join(words(30))}\n{line}"))
    known = [u[-1] for u in lines.units(line)]
    assert [u[-1] for u in spans if u[-1] in known] == known * 2


def test_a_passage_inside_longer_lines_is_removed(spark):
    passage = PASSAGES["no marks"]
    df = spark.createDataFrame([(1, f"{' '.join(words(20))} {passage} {' '.join(words(20))}"), (2, f"{' '.join(words(3))} {passage}")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in lines.repeated_units(df).collect()}
    assert got[1].n_removed == 0 and got[2].removed_chars > 0.4 * len(passage)


def test_short_phrases_stay_and_short_copies_go(spark):
    phrase, other = " ".join(words(12)), " ".join(words(9))
    data = [(1, f"{' '.join(words(30))}\n{phrase}"), (2, f"{phrase}\n{' '.join(words(30))}"), (3, other), (4, other)]
    got = {r.doc_id: r for r in lines.repeated_units(spark.createDataFrame(data, "doc_id bigint, text string")).collect()}
    assert [got[i].n_removed for i in (1, 2, 3)] == [0, 0, 0] and got[4].n_removed == got[4].n_units > 0
