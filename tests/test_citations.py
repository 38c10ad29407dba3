"""Citations and checks of answers, worked out by hand."""

from __future__ import annotations

from docweft.operators import citations

CONTEXT = [(1, 1, "chunk_a", "The Amazon river is long and carries much water through Brazil, 6400 km."), (1, 2, "chunk_b", "Rivers like the mighty Danube carry barges between several capital cities every single summer."), (1, 3, "chunk_c", None), (2, 1, "chunk_a", "Nothing."), (4, 1, "chunk_d", CONTEXT_D := "alpha bravo charlie delta echoes foxtrot golfing hotels"), (4, 2, "chunk_e", CONTEXT_D), (5, 1, "chunk_f", "x")]


def frames(spark, answers):
    return spark.createDataFrame(answers, "answer_id long, text string"), spark.createDataFrame(CONTEXT, "answer_id long, rank int, chunk_id string, text string")


def test_three_ways_of_citing(spark):
    answers, context = frames(spark, [(1, "It is long [2]. See [chunk_a] and [chunk_zz], [1], [9] and [chunk_a]."), (2, "no marks here"), (3, None), (4, "Say alpha bravo charlie delta echoes foxtrot golfing. Again alpha bravo charlie delta echoes foxtrot hotels? Only alpha bravo charlie is not enough for it."), (5, "[1]")])
    found = [tuple(r)[:5] for r in citations.build_citations(answers, context).orderBy("answer_id", "place").collect()]
    assert found == [(1, 1, "cit_1", "chunk_a", 1), (1, 2, "cit_num_2", "chunk_b", 2), (4, 1, "cit_fuzzy_1", "chunk_d", 1), (5, 1, "cit_num_1", "chunk_f", 1)]


def test_whole_verification(spark):
    answers, context = frames(spark, [(1, "The Amazon is 6400 km long [1]. Egypt has the Nile, which is 6650 km long. Yes."), (2, ""), (3, "Nothing is known."), (5, "x [1]")])
    found = {r["answer_id"]: tuple(r)[1:] for r in citations.verify_answers(answers, context).collect()}
    assert found == {1: (3, 1, 1, 0.25, False), 2: (0, 0, 0, 0.0, False), 3: (1, 0, 0, 0.85, False), 5: (0, 0, 0, 1.0, True)}
