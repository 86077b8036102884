"""Queries over whole tables that SQL can't express, against brute force on small fixtures."""

import re
from collections import Counter

from lexigrid.functions import text as t
from lexigrid.operators.search import parse
from lexigrid.plans.queries import QUERIES

TITLES = [
    "Kiln – totals", "kiln  totals", "“Kiln” totals", "Kiln_totals!", "cost in €", "½ ª year²", "Zestawienie płatności", "Přehled účtů", "Отчёт по складу", "月次 一覧", "RelatÃ³rio", "İstanbul", "e\u0301te\u0301",
    "\u2003wide\u2003gap\u00a0", "a\x1cb", "Ⅷ ٣", "a\u200db", "–", "!!!", "plain", "Plain",
]


def _stem(title):
    name = re.sub(r"[^\w\s-]", "", title.strip().lower())
    return re.sub(r"[\s_]+", "_", name) or "query"


def test_every_title_has_a_file_name(spark, tmp_path):
    rows = [(k, "a" if k % 5 else "b", v) for k, v in enumerate(TITLES)]
    spark.createDataFrame(rows, "id long, project string, title string").write.parquet(f"{tmp_path}/queries.parquet")
    stems = {r["id"]: r["stem"] for r in QUERIES["u3_safe_filename"](spark, str(tmp_path)).collect()}
    assert stems == {k: _stem(v) for k, _, v in rows}
    seen, want = Counter(), {}
    for k, project, v in rows:
        s = _stem(v)
        n = seen[project, s]
        seen[project, s] += 1
        want[k] = f"{s}_{n}.sql" if n else f"{s}.sql"
    assert {r["id"]: r["file_name"] for r in QUERIES["u4_unique_names"](spark, str(tmp_path)).collect()} == want


def test_stem_of_characters_outside_latin_1(spark):
    assert [r[0] for r in spark.createDataFrame([(v,) for v in TITLES], "v string").select(t.safe_filename(t.F.col("v"))).collect()] == [_stem(v) for v in TITLES]


def test_search_strings_as_they_stand(spark, tmp_path):
    texts = ["Relatório", "Rückstände\u00a0tag:né", "月次\u3000table:一覧 x", "a\u2003tag:Größe\u2028table:b", "é\x85tag:x", "plain", None, "a\x1ctag:sep", "–table:no", "x\u200btag:no"]
    rows = [(k, v, "tsql", v and f"{v} table:ção", None if k % 2 else "2024-01-02") for k, v in enumerate(texts)]
    spark.createDataFrame(rows, "id long, title string, dialect string, description string, created_at string").write.parquet(f"{tmp_path}/queries.parquet")
    want = {}
    for k, title, dialect, about, created in rows:
        found, _ = parse(f"table:{title or ''} tag:{dialect} {about or ''} date:{created or '-'}")
        want[k] = ("|".join(found["tag"]), "|".join(found["table"]))
    assert {r["id"]: (r["tags"], r["tables"]) for r in QUERIES["search_parse"](spark, str(tmp_path)).collect()} == want
