"""Queries of the corpus lanes and the judged channels over documents."""

from __future__ import annotations

from ..binding import VERSES_SQL, chapters, verses
from ..operators import census as C
from ..operators import judge as J


def _over_chapters(operator):
    return lambda spark, sf_dir: operator(chapters(spark, sf_dir))


QUERIES = {
    "glyph_placement": _over_chapters(J.placement),
    "scalar_census": _over_chapters(C.scalars),
    "pair_census": _over_chapters(C.pairs),
    "run_census": _over_chapters(C.runs),
    "run_lengths": _over_chapters(C.run_lengths),
    "follow_census": _over_chapters(C.follows),
    "word_forms": _over_chapters(C.word_forms),
    "doubled_census": _over_chapters(C.doubles),
    "letter_run_census": _over_chapters(C.letter_runs),
    "verse_lengths": lambda spark, sf_dir: C.verse_lengths(verses(chapters(spark, sf_dir))),
    "glyph_rarity": _over_chapters(J.rarity),
    "exact_neighbor": _over_chapters(J.exact_neighbor),
    "pooled_neighbor": _over_chapters(J.pooled_neighbor),
    "inside_words": _over_chapters(J.inside_words),
    "run_shape": _over_chapters(J.run_shape),
    "terminal_table": _over_chapters(J.terminals),
    "sentence_start": _over_chapters(J.sentence_start),
    "book_rate": _over_chapters(J.book_rate),
    "word_casing": _over_chapters(J.casing),
    "word_contexts": _over_chapters(lambda c: C.word_contexts(c).filter("before <> ''")),
    "word_doubled": _over_chapters(J.doubled),
    "letter_run": _over_chapters(J.letter_run),
    "word_length": _over_chapters(J.word_length),
    "run_clusters": _over_chapters(J.clusters),
}

ORACLES = {
    "glyph_placement": J.placement_sql(),
    "scalar_census": C.SCALARS_SQL,
    "pair_census": C.PAIRS_SQL,
    "run_census": f"WITH {C.RUNS_SQL} SELECT corpus, book, run, count(*) AS n FROM runs GROUP BY 1, 2, 3",
    "run_lengths": C.RUN_LENGTHS_SQL,
    "follow_census": f"WITH {C.FOLLOWS_SQL} SELECT corpus, book, terminal, upper, lower FROM follows",
    "word_forms": f"WITH {C.WORD_FORMS_SQL} SELECT corpus, book, word, lower, title, upper, mixed, n FROM word_forms",
    "doubled_census": f"WITH {C.DOUBLES_SQL} SELECT corpus, book, word, doubled FROM doubles",
    "letter_run_census": f"WITH {C.LETTER_RUNS_SQL} SELECT corpus, letter, length, n FROM letter_runs",
    "verse_lengths": f"SELECT corpus, book, count(*) AS verses, sum(length(regexp_replace(text, '\\p{{M}}', '', 'g')))::bigint AS graphemes, max(length(regexp_replace(text, '\\p{{M}}', '', 'g')))::bigint AS longest FROM ({VERSES_SQL}) GROUP BY 1, 2",
    "glyph_rarity": J.rarity_sql(),
    "exact_neighbor": J.exact_neighbor_sql(),
    "pooled_neighbor": J.pooled_neighbor_sql(),
    "inside_words": J.inside_words_sql(),
    "run_shape": J.run_shape_sql(),
    "terminal_table": J.TERMINALS_SQL,
    "sentence_start": J.SENTENCE_START_SQL,
    "book_rate": J.book_rate_sql(),
    "word_casing": J.casing_sql(),
    "word_contexts": f"WITH {C.WORD_CONTEXTS_SQL} SELECT corpus, book, word, before, form, n FROM word_contexts WHERE before <> ''",
    "word_doubled": J.doubled_sql(),
    "letter_run": J.LETTER_RUN_SQL,
    "word_length": J.WORD_LENGTH_SQL,
    "run_clusters": J.CLUSTERS_SQL,
}
