from vellichor.llm.encoding_repair import Mappings, aligned, damage, damaged_rows, learn

CLEAN = ["Die Oberfläche wurde geprüft bei 20 °C für Größe ± 3", "El número de fallos disminuyó según el método", "L’écart observé n’excède pas 4 – 5 µm"]


def table(spark):
    rows = []
    for k, t in enumerate(CLEAN * 90):
        rows.append((k, t, 1, "x"))
    for j, t in enumerate(CLEAN):
        rows.append((1000 + j, t.encode("utf-8").decode("cp1252"), 1, "x"))
        rows.append((1010 + j, "".join(damage(c, "cp1252>cp850") or c if c > "\x7f" else c for c in t), 1, "x"))
    rows += [(2000, "N�O", 1, "x"), (2001, None, 1, "x"), (2002, "", 1, "x"), (2003, "plain ascii", 1, "x"), (2004, "VERSÃO FINAL: NÃO HÁ CORREÇÃO", 1, "x"), (1000, CLEAN[0].encode("utf-8").decode("cp1252"), 1, "x")]
    return spark.createDataFrame(rows, "seq long, text string, row_key int, t string")


def test_aligned_runs():
    assert aligned("Größe", "GrÃ¶ÃŸe") == [("öß", "Ã¶ÃŸ")]
    assert aligned("abc", "abd") == []


def test_finds_and_restores(spark):
    df = table(spark)
    m = learn(df)
    assert any(n.startswith("utf-8>cp1252") for n in m.names) and "cp1252>cp850" in m.names
    got = damaged_rows(df, m, "seq", "text", True).collect()
    keys = sorted(r.row_key for r in got)
    assert keys == [1000, 1000, 1001, 1002, 1010, 1011, 1012, 2000]
    fixed = {r.row_key: r.restored for r in got}
    for j in range(3):
        assert fixed[1000 + j] == CLEAN[j]
        assert fixed[1010 + j] == CLEAN[j]


def test_empty_table(spark):
    df = table(spark).limit(0)
    m = learn(df)
    assert m.names == [] and damaged_rows(df, m, "seq", "text").collect() == []


def test_long_text():
    m = Mappings(["utf-8>cp1252/keep"], {})
    assert m.is_damaged("a ± " * 100_000 + "GrÃ¶ÃŸe") and not m.is_damaged("a ± " * 100_000)
