"""p2: round trips through every wrong encoding, and clean text that must stay."""

import pytest

from lexigrid.llm.garbled import SINGLE_AS, UTF8_AS, _byte_chars, garbled_fields, is_garbled, repair

CLEAN = [
    "Relatório de situação – versão 2", "Revisión de año según región", "Übersicht für die Prüfung nach Größe", "Synthèse créée à vérifier", "Отчёт по складу",
    "Κινήσεις αποθήκης", "月次 一覧", "Přehled – účty", "Zestawienie płatności", "Ångström scale", "naïve façade", "¿pendiente?", "“Held” rows", "cost in €", "½ year, m² and n° 3",
    "Список клиентов, у которых нет заказов", "уже сок тон", "Звіт про залишки; є помилки її перевірки", "Ґанок і їжак", "Извештај о стању, љубав и њива, ђак", "Справаздача пра ўсе заказы", "Съёмка объектов и щит",
    "Árvíztűrő tükörfúrógép", "Aylık stok raporu, şeker", "Şubat ayı", "Aylık rapor", "Það er skýrsla um stöðu; þýðing og æði", "Ýmsir þættir", "Situația pe lună", "Báo cáo tồn kho, không gồm", "茅台酒 联通公司", "使用SQL查询数据库",
    "先月の在庫レポート", "ﾃｽﾄ ﾃﾞｰﾀ", "지난달 재고", "דוח מלאי", "รายงานสินค้า", "पिछले महीने", "5 µm ± 3 °C × 2", "żółć źródło", "žluťoučký kůň", "ægte øl på åen",
    "├── staging\n└── done", "AÇÕES NÃO CONFORMES", "À VÉRIFIER APRÈS L'ÉTÉ", "GRÖßE ½", "VOCÊ''S", "plain ascii", "don’t – “quote”", "👩🏽‍💻 wrote it", "مرحبا", "3·10⁵ ≈ Ω",
]
WORDS = ["Relatório de situação", "Revisión del año según región", "Umsätze je Straße für später", "créé pour la clôture", "“Held” – cost"]


def _misread(text, wrong, meant="utf-8"):
    table = _byte_chars(wrong)
    return "".join(chr(b) if b < 0x80 else table[b] for b in text.encode(meant))


@pytest.mark.parametrize("text", CLEAN)
def test_clean_text_stays(text):
    assert is_garbled(text) == (False, text, "")


@pytest.mark.parametrize("wrong", UTF8_AS)
@pytest.mark.parametrize("text", WORDS + ["Отчёт по складу за месяц", "Zestawienie płatności zaległych", "上个月的库存报告"])
def test_utf8_misread(text, wrong):
    bad = _misread(text, wrong)
    hit, fixed, chain = is_garbled(bad)
    # ISO 8859-2 and Windows 1250 differ in few letters; the bytes don't tell which it was
    same = fixed == text or wrong == "iso8859_2" and repair(_misread(fixed, "cp1250"))[0] == fixed
    assert hit and chain and same


@pytest.mark.parametrize("text", WORDS[:4])
def test_layers(text):
    bad = _misread(_misread(text, "cp1252"), "cp1252")
    assert repair(bad)[0] == text and len(repair(bad)[1].split()) == 2
    assert repair(_misread(bad, "latin-1"))[0] == text


@pytest.mark.parametrize("text", ["Relatório é ção", "Größe"])
@pytest.mark.parametrize("n", [3, 7, 10])
def test_any_number_of_layers(text, n):
    bad = text
    for _ in range(n):
        bad = _misread(bad, "cp1252")
    assert repair(bad)[0] == text and len(repair(bad)[1].split()) == n


@pytest.mark.parametrize("text, wrong", [("Relatório de posição", "gbk"), ("São Paulo à noite", "gbk"), ("Отчет по складу", "gbk"), ("Lägesrapport för månaden, räksmörgås", "cp932")])
def test_utf8_misread_as_two_bytes(text, wrong):
    assert is_garbled(text.encode().decode(wrong))[:2] == (True, text)


def test_utf16():
    assert repair("SELECT name FROM kiln".encode("utf-16-le").decode("latin-1"))[0] == "SELECT name FROM kiln"
    assert repair("SELECT name FROM kilns".encode().decode("utf-16-le"))[0] == "SELECT name FROM kilns"


@pytest.mark.parametrize("wrong, meant", [p for p in SINGLE_AS if p[1] in ("cp1251", "koi8_r", "cp866")])
def test_cyrillic_swaps(wrong, meant):
    assert repair(_misread("Список клиентов, у которых нет заказов", wrong, meant))[0] == "Список клиентов, у которых нет заказов"


@pytest.mark.parametrize("wrong, meant", SINGLE_AS[:2])
@pytest.mark.parametrize("text", ["Relatório de situação", "Revisión según región", "Rückstände nach Größe"])
def test_one_byte_misread(text, wrong, meant):
    assert repair(_misread(text, wrong, meant))[0] == text


def test_part_of_a_text():
    bad = "Größe bleibt, aber " + _misread("Prüfung", "cp1252") + " nicht"
    assert is_garbled(bad)[:2] == (True, "Größe bleibt, aber Prüfung nicht")


def test_lost_characters():
    assert is_garbled("segn regi�n")[0] and is_garbled("x\x93y")[0]
    assert is_garbled("caf�, Ã¡rea")[1] == "caf�, área"


def test_fields(spark):
    rows = [(1, "RelatÃ³rio", None, "x"), (1, "RelatÃ³rio", None, "x"), (2, "Relatório", "segn �", "Ã©tÃ© " * 5000), (3, None, "", None), (None, "RelatÃ³rio", None, None)]
    df = spark.createDataFrame(rows, "id long, title string, description string, body string")
    got = {(r["query_id"], r["field"]): r["repaired"] for r in garbled_fields(df, "id", ["title", "description", "body"]).collect()}
    assert got == {(1, "title"): "Relatório", (2, "description"): "segn �", (2, "body"): "été " * 5000}
    assert garbled_fields(df.limit(0), "id", ["title"]).count() == 0
