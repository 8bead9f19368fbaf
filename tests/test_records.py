import csv
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glossoloom.operators import records as R

TEXT = st.text(alphabet='ab,"\r\n é', max_size=30)


def reference(line):
    """Brute force: fields of a valid RFC 4180 record, else None."""
    t = line[:-1] if line.endswith("\r") else line
    fields, i = [], 0
    while True:
        if t[i : i + 1] == '"':
            j, out = i + 1, ""
            while True:
                if j >= len(t):
                    return None
                if t[j] == '"' and t[j + 1 : j + 2] == '"':
                    out, j = out + '"', j + 2
                elif t[j] == '"':
                    break
                else:
                    out, j = out + t[j], j + 1
            i = j + 1
        else:
            j = i
            while j < len(t) and t[j] not in ',"\r\n':
                j += 1
            out, i = t[i:j], j
        fields.append(out)
        if i == len(t):
            return fields
        if t[i] != ",":
            return None
        i += 1


@settings(max_examples=400, deadline=None)
@given(TEXT, st.integers(1, 9))
def test_reader_equals_brute_force_for_any_chunking(line, chunk):
    fields, reason, offset = R.read_record(line, chunk=chunk)
    assert fields == reference(line)
    assert (reason is None) == (fields is not None)
    assert offset is None or 0 <= offset <= len(line)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='ab,"\n ', max_size=8), min_size=1, max_size=6))
def test_round_trip_with_the_csv_module(fields):
    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_ALL).writerow(fields)
    assert R.read_record(out.getvalue()[:-1])[0] == fields


@settings(max_examples=200, deadline=None)
@given(TEXT, st.integers(0, 30))
def test_maps_compose(text, cut):
    assert R.compose(R.transition(text[:cut]), R.transition(text[cut:])) == R.transition(text)


@pytest.mark.parametrize("line, reason, offset", [(None, "null_record", 0), ('a"b', "quote_in_bare_field", 1), ('"a"b', "text_after_closing_quote", 3), ('"a', "unclosed_quote", 2), ("a\rb", "line_break_outside_quotes", 1), ("a,b\n", "line_break_outside_quotes", 3)])
def test_reasons(line, reason, offset):
    assert R.read_record(line)[1:] == (reason, offset)


def test_width():
    assert R.read_record("", 1)[0] == [""] and R.read_record("", 2)[1] == "too_few_fields" and R.read_record("a,b", 1)[1] == "too_many_fields"


def test_chunks_of_files(spark):
    text = 'a,"b\n' + 'c""' * 50 + '\nd",e\nf,g\n'
    rows = [("one", i, text[k : k + 7]) for i, k in enumerate(range(0, len(text), 7))] + [("two", 0, None), ("two", 1, '"x')]
    got = {(r.file, r.chunk_no): r.entry_state for r in R.chunk_entry_states(spark.createDataFrame(rows, "file string, chunk_no int, text string"), block=3).collect()}
    want = dict(zip([k for k in sorted(got) if k[0] == "one"], R.entry_states([R.transition(t) for f, _, t in rows if f == "one"])))
    assert {k: v for k, v in got.items() if k[0] == "one"} == want and got["two", 1] == R.FIELD


def good(**changes):
    row = {c: "" for c in R.ANNOTATION_COLUMNS} | {"id": "x", "chapter": " 7 ", "form": "contracted", "row_hash": "0" * 64, "de_valid": "include"} | changes
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow([row[c] for c in R.ANNOTATION_COLUMNS])
    return out.getvalue()


def test_annotations(spark):
    cases = [(good(), None), (good(chapter="0"), "invalid_chapter"), (good(chapter="100"), "invalid_chapter"), (good(de_valid="exclude"), "invalid_de_exclusion_reason"), (good(de_valid="exclude", de_exclusion_reason="other"), None), (good(de_exclusion_reason="other"), "invalid_de_exclusion_reason"), (good(row_hash="A" * 64), "invalid_row_hash"), (good(zh_form="definite"), "invalid_zh_form"), (good(de_notes="x" * 200_000), None), ("\r", "too_few_fields"), (None, "null_record")]
    rows = [("f", 1, "header", "clash")] + [("f", i + 2, line, "clash") for i, (line, _) in enumerate(cases)] + [(None, None, good(), None)]
    df = spark.createDataFrame(rows, "file_name string, line_no int, line string, _rec string").drop("_rec").withColumnRenamed("file_name", "file_name")
    got = {r.line_no: r.reason for r in R.classify_annotations(df).collect()}
    assert got == {i + 2: reason for i, (_, reason) in enumerate(cases)} | {None: None}
    assert R.classify_annotations(df.limit(0)).count() == 0


def test_extra_columns_stay(spark):
    df = spark.createDataFrame([("f", 2, "a", 1, "r", 2)], "file_name string, line_no int, line string, value int, record string, fields int")
    assert R.split_records(df).collect()[0].value == 1
