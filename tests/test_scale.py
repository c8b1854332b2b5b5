"""What grew faster than its input, or differed from its SQL on larger and odder tables."""

from __future__ import annotations

import contextlib
import io
import os
import re

import pytest

from lexspan.operators import versify
from lexspan.plans import registry
from tests.conftest import DATA, assert_same


def plan_of(frame) -> str:
    """The physical plan, before adaptive execution changes it."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        frame.explain(True)
    return out.getvalue().partition("== Physical Plan ==")[2]


def documents(spark, folder, texts):
    """A folder whose documents are the texts, numbered from 0."""
    os.makedirs(folder, exist_ok=True)
    rows = [(i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/documents")
    (part,) = [f for f in os.listdir(f"{folder}/documents") if f.endswith(".parquet")]
    os.replace(f"{folder}/documents/{part}", f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["clock_repair", "merged_line"])
def test_no_frame_is_walked_again_for_every_row(spark, name):
    assert "currentrow$(), unboundedfollowing$()" not in plan_of(registry.QUERIES[name](spark, DATA))


def test_splices_of_short_texts(spark, tmp_path):
    texts = ["", "a", "ab", "abc", "abcd", "abcde", "é", "\U0001f600b", "x" * 400, None]
    assert_same(registry.QUERIES["splices"](spark, documents(spark, tmp_path, texts * 35)), registry.ORACLES["splices"], str(tmp_path))


ODD = ["", "((x))", "a.b.c,d", "..", "a", " . ", "«x» — y…", "é, é.", "\U0001f600\U00010400.  ;x", "1,2.3", "x\r\n,y\n;z\t!", "١,١", "a\x00b\x1f c", "-a-b--c-", "​. ,", "no marks here", None]


@pytest.mark.parametrize("name", ["pair_census", "glyph_placement", "unexplained_placement", "inside_words", "scalar_census", "rarity_sites", "placement_sites", "site_reasons", "site_snippets", "headline_sites", "pattern_order", "listing_lines", "judged_state", "book_rate"])
def test_marks_of_odd_texts(spark, tmp_path, name):
    texts = ODD * 12 + ["word, word " * 300 + "word ,word", "see (a) " * 60]
    assert_same(registry.QUERIES[name](spark, documents(spark, tmp_path, texts)), registry.ORACLES[name], str(tmp_path))


@pytest.mark.parametrize("name", ["judged_state", "site_reasons", "site_snippets", "placement_sites", "headline_sites", "listing_lines", "book_rate", "pattern_order"])
def test_pieces_of_texts_are_not_dealt_out(spark, name):
    """Marks and characters are counted where a text is read: nothing is grouped by the stretches between spaces."""
    assert not re.search(r"split\(text#\d+,  , -1\)", plan_of(registry.QUERIES[name](spark, DATA)))


@pytest.mark.parametrize("name", ["diff_units", "diff_changes", "diff_merge_new", "diff_merge_old", "block_texts", "structure_lint"])
def test_books_are_not_groups_of_their_own(spark, name):
    plan = plan_of(registry.QUERIES[name](spark, DATA))
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan and "Window" not in plan


def test_verse_steps_are_folded_row_by_row(spark):
    assert "aggregate(" not in plan_of(registry.QUERIES["verse_steps"](spark, DATA))
    numbers = spark.createDataFrame([("u", i, n) for i, n in enumerate([None, 5, 3, 1, 2, 9, None, 1])] + [(None, 0, 2)], "unit string, at long, number int")
    got = [(r.unit, r.number, r.step, r.verse) for r in sorted(versify.accepted(numbers).collect(), key=lambda r: (r.unit or "", r.at))]
    assert got == [(None, 2, "next", 2), ("u", None, None, 0), ("u", 5, None, 0), ("u", 3, "next", 3), ("u", 1, "restart", 1), ("u", 2, "next", 2), ("u", 9, None, 2), ("u", None, None, 2), ("u", 1, "restart", 1)]


@pytest.mark.parametrize("name", ["overlaid_books", "block_pairs"])
def test_blocks_ahead_are_read_backwards(spark, name):
    assert not re.search(r"specifiedwindowframe\(RowFrame, 1, unboundedfollowing", plan_of(registry.QUERIES[name](spark, DATA)))


@pytest.mark.parametrize("name", ["markup_lint", "overlaid_books", "structure_lint", "diff_units"])
def test_lines_of_a_book_are_not_dealt_out(spark, name):
    assert "collect_list(struct(i" not in plan_of(registry.QUERIES[name](spark, DATA)).replace("i, i#", "i")


@pytest.mark.parametrize("name", ["form_lint", "markup_lint"])
def test_tokens_are_sorted_without_their_texts(spark, name):
    """Texts are most of a book: what is put in order has their beginnings only."""
    first_sort = plan_of(registry.QUERIES[name](spark, DATA)).rpartition("Sort [book")[2]
    assert "regexp_extract(text#" in first_sort
