"""Hand-made examples of the rules, one operator at a time."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from lexspan.binding import violations
from lexspan.functions.text import words
from lexspan.operators import attributes, census, compare, diff, find, history, hygiene, judge, markup, references, tree, versify


def chapter(spark, *texts):
    return spark.createDataFrame([("c", "b", i, t) for i, t in enumerate(texts)], "corpus string, book string, chapter long, text string")


def rows(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=str)


def test_words(spark):
    text = "don't-3rd a--b 12,345 3rd father-in-law"
    (got,) = spark.createDataFrame([(text,)], "t string").select(words(F.col("t")).alias("w")).collect()
    assert got.w == ["don't", "3rd", "a", "b", "3rd", "father-in-law"]


def test_hygiene(spark):
    c = chapter(spark, "a" + "\x01" * 223 + "b", "fine\r\nlines\r\n", "stray\rhere", "x\n<<<<<<< ours\ny", " ́loose", "é held", "a b", "a  b", "\\", "")
    got = {(r.chapter, r["class"]): (r.runs, r.longest) for r in hygiene.findings(c).collect()}
    assert got == {(0, "C0Control"): (1, 223), (2, "StrayCarriageReturn"): (1, 2), (3, "ConflictMarker"): (1, 12), (4, "FreeCombiningMark"): (1, 2), (7, "NoBreakSpace"): (1, 2), (8, "StrandedBackslash"): (1, 1)}
    assert hygiene.findings(hygiene.mended(c)).filter(F.col("class").isin(*hygiene.FIXES)).count() == 0


def test_placement_fires_on_the_rare_side(spark):
    c = chapter(spark, "word, word " * 300 + "word ,word")
    got = rows(judge.placement(c).filter("glyph = ','"), "side", "class", "numerator", "denominator")
    assert got == [("after", "Letter", 1, 301), ("before", "Space", 1, 301)]


def test_rarity_needs_an_alphabet(spark):
    few, many = chapter(spark, "abc $ abc a b c a"), chapter(spark, "abc " * 2_000 + "z $")
    assert rows(judge.rarity(few), "glyph") == [("$",)]
    assert rows(judge.rarity(many), "glyph") == [("$",), ("z",)]


def test_terminals(spark):
    c = chapter(spark, "Aa bb. Cc dd. Ee ff. Gg, hh, ii, Jj. kk" + " Ll mm. Nn" * 6)
    got = {r.terminal: r.kind for r in judge.terminals(c).collect()}
    assert got["."] == "forcing" and got[","] == "mixed"


def test_book_rate_by_hand(spark):
    books = [("c", f"b{k}", k, "word (a) " * 60 + "word ( a) " * n) for k, n in enumerate([0, 0, 1, 0, 90])]
    frame = spark.createDataFrame(books, "corpus string, book string, chapter long, text string")
    got = rows(judge.book_rate(frame).filter("glyph = '(' AND side = 'after' AND class = 'Space'"), "book", "numerator", "denominator", "rate")
    assert got == [("b4", 90, 150, 6000)]


def test_letter_runs(spark):
    c = chapter(spark, "see " * 30 + "looong")
    assert rows(judge.letter_run(c), "letter", "length", "numerator") == [("o", 3, 1)]


def test_doubled(spark):
    vocabulary = " ".join(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(200))
    c = chapter(spark, vocabulary + " the the end")
    assert rows(judge.doubled(c), "word", "numerator") == [("the", 1)]


def test_length_outliers(spark):
    pairs = [("b", 1, k, 100 + k % 5, 100) for k in range(60)] + [("b", 1, 99, 900, 100)]
    frame = spark.createDataFrame(pairs, "book string, chapter int, first int, target_n long, source_n long")
    assert rows(compare.length_outliers(frame), "first") == [(99,)]
    assert compare.length_outliers(frame.filter("first < 40")).count() == 0  # too few pairs
    flat = spark.createDataFrame([("b", 1, k, 10, 10) for k in range(60)], frame.schema)
    assert compare.length_outliers(flat).count() == 0  # no spread


def test_presence(spark):
    t = spark.createDataFrame([("b", 1, 1, "x"), ("b", 1, 2, ""), ("b", 1, 4, "x")], "book string, chapter int, verse int, text string")
    s = spark.createDataFrame([("b", 1, v, "y") for v in range(1, 7)], t.schema)
    assert rows(compare.presence(t, s), "kind", "first", "last", "keys") == [("Empty", 2, 2, 1), ("Missing", 3, 3, 1), ("Missing", 5, 6, 2)]


def test_copied_runs(spark):
    frame = spark.createDataFrame([("u", "Mwanzo of the good news wa Yesu", "the beginning of the good news")], "unit string, target string, source string")
    assert rows(compare.copied_runs(frame), "run", "eligible") == [(4, 7)]


def test_typos(spark):
    forms = spark.createDataFrame([("c", w, n, 0) for w, n in [("there", 300), ("tehre", 1), ("ther", 2), ("thxre", 4), ("where", 1), ("there's", 1), ("theree", 5)]], "corpus string, word string, n long, title long")
    assert rows(compare.typos(forms), "word", "target") == [("tehre", "there"), ("ther", "there"), ("thxre", "there")]


def test_pairing(spark):
    unit = "book string, chapter int, first int, last int, at int, text string"
    t = spark.createDataFrame([("b", 1, 1, 1, 0, "t1"), ("b", 1, 2, 3, 1, "t2"), ("b", 1, 5, 5, 2, "t5"), ("b", 1, 5, 5, 3, "t5x"), ("b", 1, 9, 9, 4, "t9"), ("b", 2, 1, 2, 5, "t21")], unit)
    s = spark.createDataFrame([("b", 1, 1, 1, 0, "s1"), ("b", 1, 2, 2, 1, "s2"), ("b", 1, 3, 3, 2, "s3"), ("b", 1, 5, 5, 3, "s5"), ("b", 1, 7, 7, 4, "s7"), ("b", 2, 2, 3, 5, "s22")], unit)
    got = rows(compare.paired(t, s), "kind", "target_text", "source_text")
    assert got == sorted([("exact", "t1", "s1"), ("bridge", "t2", "s2 s3"), ("ambiguous", "t5", "s5"), ("ambiguous", "t5x", None), ("target_only", "t9", None), ("source_only", None, "s7"), ("overlap", "t21", None), ("overlap", None, "s22")], key=str)


def test_designators(spark):
    frame = spark.createDataFrame([("1,3",), ("01",), ("1-",), ("2-4a",), ("5",)], "designator string")
    got = rows(markup.designator_members(frame), "designator", "part", "first", "last")
    assert got == sorted([("01", "01", None, None), ("1,3", "1", 1, 1), ("1,3", "3", 3, 3), ("1-", "1-", None, None), ("2-4a", "2-4a", 2, 4), ("5", "5", 5, 5)], key=str)


def test_tokens_are_the_source(spark):
    src = "\\id GEN x\r\n\\c 1\n\\p\n\\v 1-2 one \\add two\\add* three\\\n\n\\v 3  four\\f + \\ft n\\f*\n"
    got = markup.tokens(spark.createDataFrame([("g", src)], "book string, src string")).orderBy("pos").collect()
    assert "".join(r.text for r in got) == src and all(src[r.start : r.start + r.len] == r.text for r in got)


def test_verse_rows(spark):
    src = "\\id GEN\n\\c 1\n\\p\n\\v 1 one\n\\v 2-3 two\n\\s1 Head\n\\p\n\\v 4 four\n"
    got = rows(markup.verse_rows(spark.createDataFrame([("g", src)], "book string, src string")), "verse", "text")
    assert got == [(1, "one"), (2, "two"), (3, "<range>"), (4, "four")]


def test_attributes(spark):
    spans = ['|lemma="a" strong="G1"', '|a keyword ', '|lemma="a", strong="G1"', '|="x"', '|x= ', '|x="a', '|x="a\\"b"', '|x=1 y=2 |', "|"]
    frame = spark.createDataFrame(list(enumerate(spans)), "id int, span string")
    got = {}
    for r in attributes.attributes(frame).orderBy("id", "at").collect():
        got.setdefault(r.id, []).append(r.malformed or (r.name, r.value))
    assert got == {0: [("lemma", "a"), ("strong", "G1")], 1: [("", "a keyword ")], 2: [("lemma", "a"), "bare-junk"], 3: ["empty-name"], 4: ["missing-value"], 5: ["unterminated-quote"], 6: [("x", "a\\"), "bare-junk"], 7: [("x", "1"), ("y", "2")]}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("MAT 1:20-2:3; MRK 1:1", "MAT 1:20-2:3; MRK 1:1"),
        ("ROM 3:21, 24-26", "ROM 3:21; ROM 3:24-26"),
        ("JUD 3", "JUD 1:3"),
        ("JUD 1-4", "JUD 1:1-4"),
        ("PSA 7:0", "PSA 7:0"),
        ("MRK 0", "MRK 0"),
        ("ROM 9, 10; 4:1", "ROM 9; ROM 10; ROM 4:1"),
        ("GEN", "GEN"),
    ],
)
def test_references(spark, text, want):
    parsed = references.parsed(spark.createDataFrame([(1, text)], "id int, text string"))
    assert references.spelled(parsed).collect()[0].text == want


@pytest.mark.parametrize(("text", "error"), [("rom 9:1", "unexpected"), ("1:3", "no-reference-before"), ("GEN 3-2", "backwards"), ("GEN 0:3", "intro-has-no-verses"), ("GEN 1:5-3", "backwards"), ("", "unexpected")])
def test_wrong_references(spark, text, error):
    assert references.parsed(spark.createDataFrame([(1, text)], "id int, text string")).collect()[0].error == error


def test_clocks(spark):
    def repaired(*times):
        frame = spark.createDataFrame([("b", i, t, t + 5) for i, t in enumerate(times)], "book string, seq long, author_at long, committer_at long")
        return [(r.estimate_at, r.device_at) for r in history.repaired_clocks(frame, 1_700_000_000).orderBy("seq").collect()]

    assert repaired(1_600_000_000, 946_684_800, 946_684_900, 1_600_010_000) == [(1_600_000_000, None), (1_600_009_899, 946_684_800), (1_600_009_999, 946_684_900), (1_600_010_000, None)]
    assert repaired(1_600_000_000, 5, 9) == [(1_600_000_000, None), (1_600_000_001, 5), (1_600_000_002, 9)]
    assert repaired(5, 9, 1_600_000_000) == [(1_599_999_998, 5), (1_599_999_999, 9), (1_600_000_000, None)]
    assert repaired(5, 9) == [(5, None), (9, None)]
    assert repaired(1_600_000_000, 50, 9, 1_600_000_030)[1:3] == [(1_600_000_010, 50), (1_600_000_020, 9)]


def test_renumbering(spark):
    counts = spark.createDataFrame([("eng", "GEN", 31, 55), ("org", "GEN", 31, 54), ("eng", "GEN", 32, 32), ("org", "GEN", 32, 33), ("eng", "PSA", 13, 6), ("org", "PSA", 13, 6), ("eng", "ACT", 19, 41), ("org", "ACT", 19, 40)], "scheme string, book string, chapter int, last int")
    mapping = "scheme string, from_book string, from_chapter int, from_verse int, to_book string, to_chapter int, to_verse int, to_part string, len int, shape string"
    lines = spark.createDataFrame([("eng", "GEN", 31, 55, "GEN", 32, 1, None, 1, "Parallel"), ("eng", "GEN", 32, 1, "GEN", 32, 2, None, 32, "Parallel"), ("eng", "PSA", 13, 5, "PSA", 13, 6, None, 2, "Merge")], mapping)
    ask = spark.createDataFrame([("GEN", 31, 55), ("GEN", 31, 1), ("PSA", 13, 5), ("ACT", 19, 41), ("GEN", 32, 32)], "book string, chapter int, verse int")
    got = {(r.book, r.chapter, r.verse): (r.verdict, r.there) for r in versify.renumbered(ask, counts, lines, "eng", "org").collect()}
    assert got == {("GEN", 31, 55): ("Moved", "GEN 32:1"), ("GEN", 31, 1): ("Same", "GEN 31:1"), ("PSA", 13, 5): ("Merged", "PSA 13:6"), ("ACT", 19, 41): ("Absent", ""), ("GEN", 32, 32): ("Moved", "GEN 32:33")}
    back = {r.verse: (r.verdict, r.there) for r in versify.renumbered(spark.createDataFrame([("PSA", 13, 6)], ask.schema), counts, lines, "org", "eng").collect()}
    assert back == {6: ("Split", "PSA 13:5; PSA 13:6")}


def test_votes(spark):
    units = spark.createDataFrame([("A", 1, v, v, v) for v in range(1, 6)] + [("B", 1, 1, 1, 1), ("B", 1, 2, 3, 3)], "book string, chapter int, at int, first int, last int")
    rules = spark.createDataFrame([("r1", "x", "Last", "A", 1, 5), ("r1", "y", "Last", "A", 1, 6), ("r2", "x", "Exist", "B", 1, 3), ("r2", "y", "Last", "B", 1, 9)], "rule string, column string, kind string, book string, chapter int, verse int")
    fits = spark.createDataFrame([("r1", "x", "one"), ("r1", "y", "two"), ("r2", "x", "one"), ("r2", "y", "two")], "rule string, column string, scheme string")
    got = rows(versify.votes(versify.inventory(units), units, rules, fits), "scheme", "agree", "disagree", "voted", "confidence")
    # B has a gap (2 is missing), so the rule that needs its last verse abstains
    assert got == [("one", 1, 0, 1, "Leaning"), ("two", 0, 1, 1, "Leaning")]


def test_find(spark):
    texts = spark.createDataFrame([(1, "The cat, the other\nTHE end of İthe"), (2, None), (3, "")], "id int, text string")
    text = "The cat, the other\nTHE end of İthe"
    starts = lambda frame: sorted(r.start for r in frame.collect())
    assert starts(find.hits(texts, "the")) == [m.start() for m in re.finditer("the", text)]
    assert starts(find.hits(texts, "the", True, True)) == [0, 9, 19]
    assert find.hits(texts, "").count() == 0


def test_offsets(spark):
    (r,) = spark.createDataFrame([("aé😀b",)], "t string").select(find.utf8_offset(F.col("t"), F.lit(3)).alias("a"), find.utf16_offset(F.col("t"), F.lit(3)).alias("b")).collect()
    assert (r.a, r.b) == (7, 4)


def test_diff_of_swapped_verses(spark):
    book = lambda *v: "\\id GEN\n\\c 1\n\\p\n" + "".join(v)
    one, two, three = "\\v 1 one\n", "\\v 2 two\n", "\\v 3 three\n"
    df = lambda s: spark.createDataFrame([("g", s)], "book string, src string")
    units = diff.diff(df(book(one, two)), df(book(two, one)))
    assert [r[0] for r in rows(units, "status")].count("Added") == 1 and [r[0] for r in rows(units, "status")].count("Deleted") == 1
    bridged = diff.diff(df(book(one, two, three)), df(book(one, "\\v 2-3 two three\n")))
    kinds = {r.id: (r.kind, r.status) for r in bridged.collect()}
    assert kinds["1:2"] == ("Coalesced", "Modified") and kinds["1:3"] == ("Deleted", "Deleted")
    marked = diff.diff(df(book(one, two)), df(book("\\v 1 \\add one\\add*\n", "\\v  2  two\n")))
    flags = {r.id: (r.whitespace, r.markup) for r in marked.collect() if r.status == "Modified"}
    assert flags.get("1:1") == (False, True)


def test_diff_decisions(spark):
    old = spark.createDataFrame([("g", "\\id GEN\n\\c 1\n\\p\n\\v 1 a\n\\v 2 b\n")], "book string, src string")
    new = spark.createDataFrame([("g", "\\id GEN\n\\c 1\n\\p\n\\v 1 A\n\\v 2 B\n")], "book string, src string")
    units = diff.diff(old, new)
    pick = spark.createDataFrame([("g", "1:1", "old")], "book string, id string, side string")
    assert diff.merged(units, pick, "new").collect()[0].src == "\\id GEN\n\\c 1\n\\p\n\\v 1 a\n\\v 2 B\n"
    with pytest.raises(ValueError, match="9:9"):
        diff.merged(units, spark.createDataFrame([("g", "9:9", "old")], pick.schema), "new")


def test_increasing():
    assert diff.increasing([2, 1]) in ([0], [1])
    assert diff.increasing([]) == [] and diff.increasing([3, 1, 2, 5, 4]) in ([1, 2, 3], [1, 2, 4])


def test_tree(spark):
    src = "\\id GEN\n\\c 1\n\\p\n\\v 1 a \\f + \\ft note\\f* b \\add c\\add* \\nd d\n\\p\n\\v 2 \\f + \\ft open\n\\p x\\wj*\n"
    books = spark.createDataFrame([("g", src)], "book string, src string")
    nodes = tree.nodes(books)
    assert {r.code: r.n for r in tree.structure_lint(nodes).collect()} == {"unclosed-note": 1, "unclosed-char": 1, "orphan-closer": 1}
    by = {r.node: r for r in nodes.collect()}
    note = next(r for r in by.values() if r.marker == "f" and r.closed == "explicit")
    assert by[note.parent].marker == "v" and next(r for r in by.values() if r.marker == "ft").parent == note.node
    own = {r.pos: r.node for r in tree.owners(nodes, markup.tokens(books)).collect()}
    assert own[note.first_pos] == note.node and len(own) == markup.tokens(books).count()


def test_violations(spark):
    verse = spark.createDataFrame([("c", "b", 1, 0, "x"), ("c", "b", 1, 1, None), ("c", "b", 1, 2, "y"), ("c", "b", 1, 2, "z"), (None, "b", 1, 3, "q")], "corpus string, book string, chapter int, verse int, text string")
    assert rows(violations(verse), "kind", "n") == [("null key", 1), ("null text", 1), ("repeated key", 1), ("verse below 1", 1)]


def test_empty_texts_count_nothing(spark):
    c = chapter(spark, "", None)
    assert census.triples(c).count() == 0 and census.runs(c).count() == 0 and judge.placement(c).count() == 0


def test_casing_counts_free_places_only(spark):
    starts = "Lord is. Lord was. Lord will. " * 20
    c = chapter(spark, starts + "the lord and " * 400 + "my LORD here")
    assert rows(judge.casing(c).filter("word = 'lord'"), "form", "numerator", "denominator") == [("upper", 1, 401)]


def test_word_length(spark):
    c = chapter(spark, "ab cd ef " * 600 + "extraordinarily " * 20)
    assert rows(judge.word_length(c), "word", "numerator", "denominator") == [("extraordinarily", 20, 1820)]


def test_marks_inside_words(spark):
    c = chapter(spark, "one) two " * 400 + "(three " * 400 + "fo)ur")
    assert rows(judge.inside_words(c), "glyph", "numerator") == []  # a letter before ) is usual, one after it departs by itself
    c = chapter(spark, "one' two " * 300 + "'three four " * 300 + "fi've")
    assert rows(judge.inside_words(c), "glyph", "numerator", "denominator") == [("'", 1, 601)]


def test_formatting(spark):
    from lexspan.operators import formatting

    src = "\\id GEN\r\n\r\n  \\c 1\n\\p  \\v 1   one \\s5\n\\v 2 two  \\q1 x\n"
    got = formatting.formatted(spark.createDataFrame([("g", src)], "book string, src string"), remove=("s5",)).collect()[0].src
    assert got == "\\id GEN\n\\c 1\n\\p \\v 1 one\n\\v 2 two\n\\q1 x\n"


def test_word_changes_tile_both_sides(spark):
    units = spark.createDataFrame([("u", "the cat sat, on the mat", "the dog sat on  the mat!"), ("v", None, "new"), ("w", "same", "same")], "unit string, old string, new string")
    got = {}
    for r in diff.word_changes(units).orderBy("unit", "at").collect():
        got.setdefault(r.unit, []).append((r.change, r.old, r.new))
    for unit, old, new in [("u", "the cat sat, on the mat", "the dog sat on  the mat!"), ("v", "", "new"), ("w", "same", "same")]:
        assert "".join(o for _, o, _ in got[unit]) == old and "".join(n for _, _, n in got[unit]) == new
    assert ("changed", "cat", "dog") in got["u"] and got["w"] == [("same", "same", "same")]


def test_manifest_check(spark):
    from lexspan.sources import checks

    listed = spark.createDataFrame([("a.usfm", 3, "x"), ("gone.usfm", 1, "y"), ("big.usfm", 9, None)], "name string, size long, md5 string")
    files = spark.createDataFrame([("a.usfm", bytearray(b"abc")), ("big.usfm", bytearray(b"12345678")), ("extra.txt", bytearray(b"?"))], "name string, content binary")
    assert rows(checks.ingredients(listed, files), "name", "problem") == [("a.usfm", "checksum"), ("big.usfm", "size"), ("extra.txt", "unlisted"), ("gone.usfm", "missing")]


def test_markers_are_spelled_by_rule():
    from lexspan.operators.markers import FAMILIES, MARKERS

    assert MARKERS["q4"] == "paragraph" and "q5" not in MARKERS and "s5" not in MARKERS and MARKERS["tc12"] == "cell"
    assert FAMILIES["mt"] == FAMILIES["mt3"] == "mt" and "p" not in FAMILIES and MARKERS["wj"] == "char" and MARKERS["xt"] == "notechar"


def test_custom_markers():
    from lexspan.operators.markers import definitions, with_custom

    text = "﻿\\marker zmyp\r\n\\category versepara\r\n\\description A paragraph.\n\\attribute a\n\\attribute b\n\n\\marker foo\n\\category char\n\\marker zx\n\\category nonsense\n\\marker zmyp\n\\category char\nplain\n\\odd x\n"
    kept, flaws = definitions(text)
    assert kept == [{"name": "zmyp", "category": "versepara", "description": "A paragraph.", "attributes": ["a", "b"]}]
    assert [(n, w) for n, _, w in flaws] == [(7, "not a custom name"), (9, "no category"), (10, "unknown category"), (11, "defined twice"), (13, "not a field"), (14, "unknown field")]
    assert with_custom(text)["zmyp"] == "paragraph" and "foo" not in with_custom(text)
    assert definitions("\\category char\n") == ([], [(1, None, "field before the first marker")])


def test_form_lint_by_hand(spark):
    from lexspan.operators.form import form_lint

    cases = {
        "\\id GEN\n\\c 1\n\\ca 2\\ca*\n\\cp X\n\\p\n\\v 1 \\va 2\\va* a\n": {},
        "\\id GEN\n\\c 1\n\\p\n\\v 1 a \\va 2\\va* \\vp 3\\vp* b\n": {"va-vp-placement": 1},
        "\\id GEN\n\\c 1\n\\s1 Head\n\\v 1 a\n\\v 2 b\n\\c 2\n\\v 1 a\n": {"missing-paragraph": 2},
        "\\id GEN\n\\c 1\n\\p\n\\v 1 a \\f + \\ft \\+nd x\\+nd* \\f*text\\p more\n": {"marker-not-ws-preceded": 1},
        "\\id GEN\n\\usfm 2.4\n\\c 1\n\\p\n\\v 1 \\addpn x\\addpn*\n": {},
        "\\id GEN\n\\usfm 3.1\n\\c 1\n\\p\n\\v 1 \\addpn x\\addpn*\n\\ph2 y\n": {"deprecated-marker": 2},
        "\\id GEN\n\\mt T\n\\h late\n\\c 1\n\\p\n\\v 1 a\n": {"marker-out-of-band": 1, "delimiter-shape": 1},
        "\\id GEN\n\\c 1\n\\q1 a\n\\q2 b\n\\li c\n\\li2 d\n\\li3 e\n\\f +\\ft glued\\f*\n": {"numbering-mix": 1},
    }
    frame = spark.createDataFrame([(str(i), s) for i, s in enumerate(cases)], "book string, src string")
    got = {}
    for r in form_lint(frame).collect():
        got.setdefault(int(r.book), {})[r.code] = r.n
    for i, (src, want) in enumerate(cases.items()):
        assert got.get(i, {}) == want, src


def test_chapter_scan_and_units(spark):
    from lexspan.operators import listing

    books = spark.createDataFrame([("a", "\\id GEN\n\\c 1\n\\p \\v 1 a\n\\c 2\n\\p \\v 1 b\n"), ("b", "x \\c 1\r\ny\n"), ("c", "")], "book string, src string")
    got = {r.book: (r.starts, r.lf, r.crlf) for r in listing.chapter_scan(books).collect()}
    assert got == {"a": ("0,8,23", 5, 0), "b": ("0", 1, 1), "c": ("0", 0, 0)}
    text = "Don't, 3rd-class x--y!"
    units = listing.display_units(spark.createDataFrame([(1, text)], "id int, text string")).orderBy("at").collect()
    assert "".join(u.unit for u in units) == text and [u.unit for u in units if u.is_word] == ["Don't", "3rd-class", "x", "y"]
    assert all(text[u.start :].startswith(u.unit) for u in units)


def test_insertion_points_by_hand(spark):
    from lexspan.operators.compare import insertion_points

    kind = "book string, chapter int, verse int, begin long, end long"
    target = spark.createDataFrame([("a", 1, 2, 10, 20), ("a", 1, 5, 20, 30), ("a", 2, 1, 40, 50)], kind)
    source = spark.createDataFrame([("a", 1, v, 0, 0) for v in (1, 2, 3, 6)] + [("a", 3, 1, 0, 0), ("b", 1, 1, 0, 0)], kind)
    got = {(r.book, r.chapter, r.verse): r.at for r in insertion_points(target, source).collect()}
    assert got == {("a", 1, 1): 10, ("a", 1, 3): 20, ("a", 1, 6): 30, ("a", 3, 1): 50, ("b", 1, 1): 0}


def test_search_fold():
    from lexspan.functions.unicode import folded

    assert [folded(x) for x in ("Éàñ", "ﬁx", "Ⅳ", "áb", "ß", "")] == ["ean", "fix", "iv", "ab", "ß", ""]


def test_citations_by_hand(spark):
    from lexspan.operators.references import catalogue, cited

    texts = {1: "Mateo 5:3-7; 6:1", 2: "1john 2:3", 3: "phil", 4: "Mat 3, 1", 5: "Luke intro", 6: "Jude 3", 7: "Nowhere 3", 8: "", 9: "Song of Songs 2:1; 2 kings 4"}
    frame = spark.createDataFrame(list(texts.items()), "id int, text string")
    got = {}
    for r in cited(frame, catalogue(spark, {"Mateo": "MAT"})).orderBy("id", "at").collect():
        got.setdefault(r.id, []).append((r.book, r.from_chapter, r.from_verse, r.to_verse, r.assumed, r.error))
    assert got[1] == [("MAT", 5, 3, 7, False, None), ("MAT", 6, 1, 1, False, None)]
    assert got[2] == [("1JN", 2, 3, 3, False, None)] and got[3] == [("PHP", None, None, None, True, None)]
    assert got[4] == [("MAT", 3, None, None, False, None), ("MAT", 1, None, None, False, None)] and got[5] == [("LUK", 0, None, None, False, None)]
    assert got[6] == [("JUD", 1, 3, 3, False, None)] and got[7][0][-1] == "unknown-book"
    assert got[9] == [("SNG", 2, 1, 1, False, None), ("2KI", 4, None, None, False, None)]


def test_facing_and_placements(spark):
    from lexspan.operators import census, hygiene

    chapter = spark.createDataFrame([("en", "b", 1, "Manasseh'.\"\nsaid, \"... don't 5\". x")], "corpus string, book string, chapter int, text string")
    got = {r.run: (r.facing, r.n) for r in census.faced_runs(chapter).collect()}
    assert got == {"'.\"": ("Closing", 1), ",": (None, 1), "\"...": ("Unknown", 1), "'": ("Inside", 1), "\".": ("Closing", 1)}
    odd = spark.createDataFrame([("en", "b", k, t) for k, t in enumerate(["\x01", "\x01a", "a \x01b", "a,\x01b", "a\x01\x02b", "1\x01b", "clean"])], "corpus string, book string, chapter int, text string")
    found = {(r.book, r.placement): r.runs for r in hygiene.placements(odd).collect()}
    assert {k[1]: n for k, n in found.items() if k[0] is None} == {"Alone": 1, "AtEdge": 1, "BesideSpace": 1, "BesidePunctuation": 1, "BetweenLetters": 1, "Other": 1}


def test_verse_steps_by_hand(spark):
    from lexspan.operators.versify import accepted

    numbers = [1, 2, 2, 5, 9, 1, 4, 1000]
    rows = spark.createDataFrame([("u", i, n) for i, n in enumerate(numbers)], "unit string, at long, number int")
    got = [(r.step, r.verse) for r in accepted(rows).orderBy("at").collect()]
    assert got == [("next", 1), ("next", 2), (None, 2), ("next", 5), (None, 5), ("restart", 1), ("next", 4), (None, 4)]


def test_overlay_by_hand(spark):
    from lexspan.operators.overlay import overlaid

    source = "\\id GEN\n\\c 2\n\\p\n\\v 21 So\n\\v 22 And\n\\v 23 he said\n\\q1 This\n\\p\n\\v 24 For\n"
    target = "\\id GEN\n\\c 2\n\\m\n\\v 21 Y\n\\v 22 Y\n\\q1\n\\v 23 dijo\n\\v 24 Por\n"
    frame = lambda s: spark.createDataFrame([("GEN", s)], "book string, src string")
    (got,) = overlaid(frame(target), frame(source)).collect()
    assert got.error is None and got.src == "\\id GEN\n\\c 2\n\\p\n\\v 21 Y\n\\v 22 Y\n\\v 23 dijo\n\\p\n\\v 24 Por\n"


def test_manifests_are_edited(spark):
    from lexspan.sources import writers

    docs = spark.createDataFrame([("a", '{"x": 1, "y": {"z": [2]}}')], "path string, json string").select("path", F.parse_json("json").alias("doc"))
    (got,) = writers.manifest_with(docs, {"x": 'new "x"', "w": "v"}).collect()
    import json

    assert json.loads(got.json) == {"x": 'new "x"', "y": {"z": [2]}, "w": "v"}


def test_html_report_is_well_formed(spark):
    from xml.etree import ElementTree

    from lexspan.sources import writers

    lines = spark.createDataFrame([("en", 1, "placement < 3/4"), ("en", 2, "rarity & 1/9"), ("fr", 1, "x")], "corpus string, place int, line string")
    sites = spark.createDataFrame([("en", "placement", "b", 1, 5, "a <\nb>")], "corpus string, headline string, book string, chapter long, at int, snippet string")
    pages = {r.corpus: ElementTree.fromstring(r.html) for r in writers.html_report(lines, sites).collect()}
    assert [x.text for x in pages["en"].iter("li")] == ["placement < 3/4", "rarity & 1/9", "placement b 1: a < b>"] and len(list(pages["fr"].iter("li"))) == 1


def test_refined_references(spark):
    from lexspan.operators.references import refined, word_places

    texts = ["MAT 2:1!3", "MAT 2:1!3-2!4", "en+ulb.ROM 1:1", "MAT 1:1!5+6", "GEN 1:1!8@strong", "MAT 2:1!3-5", "GEN 1:1-end", "ROM 9:end!2+0", "", "gen 1:1", "QQQ 1:1", "GEN 1:x", "GEN 1:3!4-2", "GEN 1:3-2"]
    got = {r.id: tuple(r)[1:] for r in refined(spark.createDataFrame(list(enumerate(texts)), "id int, text string")).collect()}
    none = (None,) * 11
    assert got[0] == (None, "MAT", "2", "1", None, "3", None, None, None, None, None, None)
    assert got[1] == (None, "MAT", "2", "1", None, "3", None, None, "2", "4", None, None)
    assert got[2] == ("en+ulb", "ROM", "1", "1", None, None, None, None, None, None, None, None)
    assert got[3][5:7] == ("5", "6") and got[4][5:8] == ("8", None, "strong") and got[5][8:10] == ("1", "5") and got[6][8:10] == ("end", None) and got[7][3:7] == ("end", None, "2", "0")
    assert [got[i][-1] for i in range(8, 14)] == ["empty", "expected-book", "unknown-book", "unexpected", "backwards", "backwards"] and got[8][:-1] == none
    verse = spark.createDataFrame([("MAT", 2, 1, "Now when, Jesus"), ("MAT", 2, 2, "x"), ("MAT", 3, 1, "a"), ("MAT", 3, 1, "b")], "book string, chapter long, verse int, text string")
    asked = ["MAT 2:1!3", "MAT 2:1!end+1", "MAT 2:end!1", "MAT 2:1!4", "MAT 2:9!1", "MAT 3:1!1", "MAT 2:2!1+3"]
    found = {r.id: (r.found, r.problem) for r in word_places(refined(spark.createDataFrame(list(enumerate(asked)), "id int, text string")), verse).collect()}
    assert found == {0: ("Jesus", None), 1: ("J", None), 2: ("x", None), 3: (None, "word"), 4: (None, "verse"), 5: (None, "ambiguous"), 6: (None, "character")}
