"""Malformed CSV lines: kept, counted, and the rest read as the usual reader does."""

import csv
import io
import os

from hypothesis import HealthCheck, given, settings, strategies as st

from churnscope.sources.quarantine import read_checked


def put(folder, *files):
    for i, text in enumerate(files):
        with open(os.path.join(folder, f"{i}.csv"), "w", encoding="utf-8", newline="") as f:
            f.write(text)
    return folder


def test_reasons_and_rows(spark, tmp_dir):
    path = put(tmp_dir, 'a,b,"c d"\n1,2,3\n3,4,5,6\n7,8\n\n"x,y","q""q",z\n9,"open,1\n5" pipe,6" x,2\n a , b ,N/A\n,,\n1,2,\n"p"s,2,3\n',
               "a,b,c d\r\n1,2,3\r\nonly\r\n" + ",".join("x" * 30000) + "\r\n")
    got = read_checked(spark, path)
    assert got.data.columns == ["a", "b", "c d"]
    rows = sorted(tuple(r) for r in got.data.na.fill("~").collect())
    assert rows == sorted([("1", "2", "3"), ("7", "8", "~"), ("x,y", 'q"q', "z"), ('5" pipe', '6" x', "2"), (" a ", " b ", "~"),
                           ("~", "~", "~"), ("1", "2", "~"), ('"p"s', "2", "3"), ("1", "2", "3"), ("only", "~", "~")])
    bad = sorted((r.line[:12], r.reason, r.in_data) for r in got.quarantine.collect())
    assert bad == [("3,4,5,6", "too many fields", False), ("7,8", "too few fields", True), ('9,"open,1', "broken quotes", False),
                   ("only", "too few fields", True), ("x,x,x,x,x,x,", "too many fields", False)]
    assert {r.file.rsplit("/", 1)[1] for r in got.quarantine.where("line = 'only'").collect()} == {"1.csv"}
    assert {(r.reason, r.lines) for r in got.counts().collect()} == {("broken quotes", 1), ("too few fields", 2), ("too many fields", 2)}


def test_header_only_and_blank(spark, tmp_dir):
    got = read_checked(spark, put(tmp_dir, "a,b\n", "a,b\n\n   \n"))
    assert got.data.count() == 0 and got.quarantine.count() == 0


cell = st.text(st.sampled_from('ab",; é'), max_size=6)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(cell, min_size=1, max_size=5).map(tuple), min_size=1, max_size=12))
def test_every_line_is_a_row_or_listed(spark, tmp_path_factory, table):
    buf = io.StringIO()
    writer = csv.writer(buf, quoting=csv.QUOTE_ALL, lineterminator="\n")
    for row in table:
        writer.writerow(row)
    got = read_checked(spark, put(str(tmp_path_factory.mktemp("csv")), "a,b,c\n" + buf.getvalue()), na_tokens=("",))
    want = sorted(tuple((list(r) + [""] * 3)[:3]) for r in table if len(r) <= 3)
    assert sorted(tuple(v or "" for v in r) for r in got.data.collect()) == want
    assert got.quarantine.where("not in_data").count() == sum(len(r) > 3 for r in table)
    assert got.quarantine.where("in_data").count() == sum(len(r) < 3 for r in table)
