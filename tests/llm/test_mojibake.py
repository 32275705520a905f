import pytest
from pyspark.sql import functions as F

from siltworks.llm.mojibake import repair_encoding, repair_text

RIGHT = ["Größe überschreitet die Länge", "La sesión del año caducó", "NÃO ALTERE A SEÇÃO", "Zażółć gęślą jaźń", "Người dùng đã hết hạn", "Сессия требует внимания", "配置文件 没有找到", "設定ファイル が見つかりません", "├── a │ b └── c", "═══ limits ═══", "£12 / €15 / ¥900", "21 °C ± 0.5 µm", "«à» “b” ‘c’ – …", "Šķēršļi nav atrasti", "put a blank in place of � here", "α ≤ β → γ", "caf&#233; cr&#232;me", "plain", "", "été à Ærø, Þórður"]
WRONG = [("Größe überschreitet die Länge", "utf-8", "cp1252"), ("La sesión del año caducó", "utf-8", "mac_roman"), ("Le dépôt a échoué côté réseau", "utf-8", "cp437"), ("Сессия требует внимания", "utf-8", "cp1251"), ("Błąd zapisu wymaga ręcznej zgody", "utf-8", "cp1250"), ("配置文件 没有找到", "utf-8", "gbk"), ("Загрузка файла завершена", "cp1251", "latin-1"), ("Проверка отчёта завершена", "koi8_r", "cp1251"), ("検索結果 が見つかりません", "utf-8", "latin-1"), ("评分结果 需要人工检查", "gbk", "latin-1"), ("Die Änderung ist ungültig", "utf-8", "cp850")]


@pytest.mark.parametrize("text", RIGHT)
def test_right_text_stays(text):
    assert repair_text(text) == (text, 0, 0)


@pytest.mark.parametrize("text, meant, read", WRONG)
def test_round_trip(text, meant, read):
    bad = text.encode(meant).decode(read)
    assert repair_text(f"x = 1\n# {bad}\r\ny")[0] == f"x = 1\n# {text}\r\ny"


def test_layers_numbers_and_pieces():
    twice = "señal".encode().decode("latin-1").encode().decode("latin-1")
    assert repair_text(twice) == ("señal", 1, 1)
    assert repair_text("fa&#195;&#167;ade") == ("fa&#231;ade", 1, 1)
    assert repair_text("✓ für fÃ¼r")[0] == "✓ für für"
    assert repair_text("﻿grÃ¶ÃŸer")[0] == "﻿größer"


@pytest.mark.parametrize("text", ["La requ�te", "BÅ\x82Äd zapisu bÄ\x99dzie pÃ³Åºniej"])
def test_what_is_lost_is_found_but_not_called_restored(text):
    _, garbled, restored = repair_text(text)
    assert garbled > restored


def test_rows(spark):
    rows = [(1, "grÃ¶ÃŸer\n" * 9, "k"), (2, None, None), (3, "", ""), (4, "größer", "x"), (1, "grÃ¶ÃŸer\n" * 9, "k"), (5, "x" * 100_000 + " Ã©", "l")]
    df = spark.createDataFrame(rows, "id int, t string, repaired string")
    got = repair_encoding(df, "t")
    assert got.columns == ["id", "t", "repaired", "garbled_pieces", "restored_pieces"]
    assert sorted((r["id"], r["garbled_pieces"], r["repaired"][:6]) for r in got.collect()) == [(1, 9, "größer"), (1, 9, "größer"), (5, 1, "xxxxxx")]
    assert repair_encoding(df.where(F.lit(False)), "t").count() == 0
