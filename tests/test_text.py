"""Record text: reading, writing, checksums, repair."""

from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st

from fieldframe.sources import text, values
from fieldframe.sources.text import Options, read
from fieldframe.sources.values import RecordError

PLAIN = Options(normalize=False)


@pytest.mark.parametrize(
    ("given_text", "options", "want"),
    [
        ("F12=1;F7=2;F23=3", PLAIN, "F7=2\nF12=1\nF23=3"),
        ("F12:i=14532;F7:b=1;F23:s=admin", PLAIN, "F7=1\nF12=14532\nF23=admin"),
        ("F14:ba=[1 ,0 ,true ,False ];F13:fa=[1.10, 2.20 ,3.30];F12:ia=[1, 2 ,3 ,-4]", PLAIN, "F12=[1,2,3,-4]\nF13=[1.1,2.2,3.3]\nF14=[1,0,1,0]"),
        ("F12:i=9223372036854775807", PLAIN, "F12=9223372036854775807"),
        ("F12:i=14532#36AAE667", Options(normalize=False, validate_checksums=True), "F12=14532"),
        ("F50:r={F12=1;F7=1}#E5FB3557", Options(normalize=False, validate_checksums=True), "F50={F7=1;F12=1}"),
        ("F23=admin;F12=1;F7=2", PLAIN, "F7=2\nF12=1\nF23=admin"),
        ("# a comment, with ? and \"\nF1=x\n\n# more\nF2=y\n", PLAIN, "F1=x\nF2=y"),
        ("F100={F1=user;F2={F10=nested;F11=[a,b,c]};F3=[{F20=1},{F20=2}]}", PLAIN, "F100={F1=user;F2={F10=nested;F11=[a,b,c]};F3=[{F20=1},{F20=2}]}"),
        ("F1=yes;F2=0;F3=no;F4=2", Options(), "F1=1\nF2=0\nF3=0\nF4=2"),
        ("", PLAIN, ""),
    ],
)
def test_reads(given_text, options, want):
    assert values.record_text(read(given_text, options)) == want


@pytest.mark.parametrize(
    ("given_text", "options", "want"),
    [
        ("F12:i=14532#DEADBEEF", Options(normalize=False, validate_checksums=True), "ChecksumMismatch"),
        ("FXX=1", PLAIN, "UnexpectedToken"),
        ("F12:i=notanumber", PLAIN, "TypeHintMismatch"),
        ("F15:f=notafloat", PLAIN, "TypeHintMismatch"),
        ("F7:b=maybe", PLAIN, "TypeHintMismatch"),
        ("F12:i=1", Options(), "TypeHintMismatch"),
        ("F12:i=14532#ABC", PLAIN, "InvalidChecksum"),
        ("F12:i=14532#GGGGGGGG", PLAIN, "InvalidChecksum"),
        ("F1=" + "{F1=" * 12 + "1" + "}" * 12, Options(max_depth=10), "NestingTooDeep"),
        ("F12=1\nF12=2", Options(strict=True), "DuplicateFieldId"),
        ("F23=admin\nF12=1\nF7=2", Options(strict=True), "StrictModeViolation"),
        ("F1=1;F2=2", Options(strict=True), "StrictModeViolation"),
        ("F65536=value", PLAIN, "InvalidFieldId"),
        ('F1="open', PLAIN, "UnterminatedString"),
        (r'F1="a\q"', PLAIN, "InvalidEscapeSequence"),
        ("F1:zz=1", PLAIN, "InvalidTypeHint"),
        ("F1=1", Options(require_checksums=True), "ChecksumMismatch"),
        ("F1=[1,2]", PLAIN, "UnexpectedToken"),
        ("F1=aaaa", Options(max_string=3), "InvalidNestedStructure"),
    ],
)
def test_errors(given_text, options, want):
    with pytest.raises(RecordError) as e:
        read(given_text, options)
    assert e.value.row["class"] == want


def test_error_has_a_place():
    with pytest.raises(RecordError) as e:
        read("F1=a\nF2=?", PLAIN)
    assert (e.value.row["line"], e.value.row["col"]) == (2, 4)


@pytest.mark.parametrize(
    ("level", "given_text", "want"),
    [
        ("normal", 'F1=1;F2="ok"', 'F1=1;F2="ok"'),
        ("normal", '  F1=1 ;  F2="hi"  \n', 'F1=1;F2="hi"\n'),
        ("normal", 'F1="hello', 'F1="hello"'),
        ("aggressive", "F1=true;F2=no", "F1=1;F2=0"),
        ("minimal", "#comment\nF1=1", "#comment\nF1=1"),
        ("minimal", "F1=1  \nF2=2\t", "F1=1\nF2=2"),
        ("normal", 'F1="Hello \\"world\\""', 'F1="Hello \\"world\\""'),
        ("normal", "F1=a b;F2=c", 'F1="a b";F2=c'),
        ("aggressive", "F1=007;F2=0", "F1=7;F2=0"),
    ],
)
def test_sanitize(level, given_text, want):
    assert text.sanitize(given_text, level, numbers=True) == want


@pytest.mark.parametrize(
    ("fid", "tag", "value", "want"),
    [(12, "i", 14532, "36AAE667"), (7, "b", True, "75914A43"), (23, "sa", ["admin", "dev"], "1CCB4860"), (15, "f", 3.14, "1CE5E4F8"), (23, "s", "admin", "BA709DC7"), (60, "ia", [1, 2, 3, -4], "0BC5EA09"), (62, "ba", [True, False, True, False], "1FC6D662"), (71, "ra", [[(12, "i", 1)], [(12, "i", 2)]], "E4006528"), (15, "f", -0.0, "C79903DF"), (50, "r", [(12, "i", 1), (7, "i", 1)], "E5FB3557")],
)
def test_checksums(fid, tag, value, want):
    assert f"{values.checksum(fid, tag, value, tag):08X}" == want


def test_quotes():
    for bare in ("abc", "a-b_c.d", "F12"):
        assert values.string_text(bare) == bare
    for quoted in ("", "true", "No", "1e5", "+1", ".5", "5.", "inf", "nan", "a b", "é", "12"):
        assert values.string_text(quoted).startswith('"')


def test_canonical_drops_empties_children_first():
    rec = [(5, "s", ""), (3, "r", [(1, "sa", [])]), (2, "ra", []), (1, "i", 0)]
    assert values.canonical(rec) == [(1, "i", 0)]


def test_short_form():
    assert text.expand_short('12=1;7="a;3=4";9={1=2;3=[{4=5}]}') == 'F12=1;F7="a;3=4";F9={F1=2;F3=[{F4=5}]}'


scalars = st.one_of(
    st.tuples(st.just("i"), st.integers(-(10**6), 10**6)),
    st.tuples(st.just("f"), st.floats(-1e6, 1e6, allow_nan=False).filter(lambda x: x != int(x))),
    st.tuples(st.just("b"), st.booleans()),
    st.tuples(st.just("s"), st.text("abcXYZ09 \"\\\n;=[]{}#é", min_size=1, max_size=8).filter(lambda s: not s[0].isdigit())),  # 0X is read as a number, as it should be
    st.tuples(st.just("sa"), st.lists(st.text("abcXYZ", min_size=1, max_size=8), min_size=1, max_size=3)),
)
fields = st.recursive(scalars, lambda inner: st.one_of(st.tuples(st.just("r"), st.lists(inner, min_size=1, max_size=3).map(lambda xs: [(k + 1, *x) for k, x in enumerate(xs)]))), max_leaves=6)
records = st.lists(st.tuples(st.integers(0, 65535), fields), max_size=8).map(lambda xs: [(fid, *x) for fid, x in xs])


@given(records)
def test_round_trip(rec):
    shown = values.record_text(rec, hints=True, checksums=True)
    back = read(shown, Options(normalize=False, validate_checksums=True))
    assert back == values.canonical(rec)
    assert values.canonical(values.canonical(rec)) == values.canonical(rec)


@given(records)
def test_field_rows_round_trip(rec):
    unique = list({f[0]: f for f in rec}.values())
    assert values.from_rows(values.field_rows(unique)) == unique


def test_modes(spark):
    df = spark.createDataFrame([(1, "F1=x"), (2, "F1="), (3, None)], "id int, t string")
    assert [(r.id, r.canonical, r.error and r.error["class"]) for r in text.parse(df, "t", "id").orderBy("id").collect()] == [(1, "F1=x", None), (2, None, "UnexpectedToken"), (3, "", None)]
    assert text.parse(df, "t", "id", mode="dropmalformed").count() == 2
    with pytest.raises(Exception, match="RecordError"):
        text.parse(df, "t", "id", mode="failfast").collect()
