"""Terms without white space are tested against distinct words, not against every text."""

import pytest

from jobsift.operators import term_index

TEXTS = [(1, "Learning C++ and node.js, learning!"), (2, "x-learning\nNew York 2nd"), (2, "relearning"), (3, ""), (4, None),
         (5, "newyork Zürich,züri"), (None, "LEARNING\tnew  york"), (6, "a.b learning " * 50)]
TERMS = [(10, "learning"), (10, "LEARN"), (11, "c++"), (12, "node.js"), (13, "new york"), (14, "züri"), (15, "2n"), (16, "-"),
         (17, " z"), (18, "\tnew"), (None, "a.b"), (19, None)]


@pytest.mark.parametrize("blank", [False, True])
@pytest.mark.parametrize("lines", [False, True])
def test_matches_are_those_of_contains(spark, lines, blank):
    terms = TERMS + [(20, "")] * blank
    got = term_index.matches(spark.createDataFrame(TEXTS, "id long, text string"), ["id"], "text",
                             spark.createDataFrame(terms, "owner long, term string"), lines=lines).collect()
    want = {(i, o) for i, text in TEXTS for o, term in terms if text is not None and term is not None and term.lower() in text.lower()}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_words_of_all_texts_meet_the_terms_once(spark, monkeypatch):
    sizes, write = {}, term_index.materialize

    def counted(df, tag):
        out = write(df, tag)
        sizes[tag] = out.count()
        return out
    monkeypatch.setattr(term_index, "materialize", counted)
    texts = spark.range(500).selectExpr("id", "repeat('some learning, here ', 20) AS text")
    found = term_index.matches(texts, ["id"], "text", spark.createDataFrame([(1, "earning")], "owner long, term string"))
    assert found.count() == 500
    assert (sizes["words"], sizes["word-matches"]) == (1, 1)  # "some" and "here" are shorter than the term
