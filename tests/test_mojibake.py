"""Texts read with wrong tables come back; clean texts stay."""

import pytest
from pyspark.sql import functions as F

from gridline.functions import mojibake as M

CLEAN = ["Резец токарный проходной", "Пластина твердосплавная, 5 шт.", "ДЕРЖАВКА", "Сверло по металлу Ø12 – «Guhring»", "Фреза концевая", "Патрон цанговый ER32", "головка расточная"]
LATIN = ["Über die Brücke gehen", "déjà vu à l'hôtel", "El niño come piñas", "naïve façade", "Straße größer", "señor"]
MIXED = ["Pe3eц", "NЛACTUHA", "державkа", "CCМТ120404", "паrрон", "D`Andrea", "“lscar” – 2 ШТ", "№ 5", "°C ±0.5", "é", "ж", "日本語", "", None, "plain"]


def misread(text, written, seen):
    return text.encode(written).decode(seen, errors="strict")


def damaged():
    out = []
    for text in CLEAN:
        for written, seen in (("utf-8", "latin-1"), ("cp1251", "latin-1"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("koi8-r", "latin-1")):
            try:
                out.append((misread(text, written, seen), text))
            except UnicodeError:
                continue
        out.append((misread(misread(text, "utf-8", "latin-1"), "utf-8", "latin-1"), text))
        whole = "".join(bytes([b]).decode("cp1251", errors="ignore") or chr(b) for b in text.encode())  # 0x98 has no sign there
        out.append((whole, text))
    for text in LATIN:
        out += [(misread(text, "utf-8", "latin-1"), text), (misread(misread(text, "utf-8", "latin-1"), "utf-8", "latin-1"), text)]
    return out


@pytest.fixture(scope="module")
def repair(spark):
    def run(texts):
        df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", M.repaired(F.col("t")).alias("t"))
        return [r["t"] for r in sorted(df.collect())]

    return run


def test_misread_texts_come_back(repair):
    pairs = damaged()
    got = repair([d for d, _ in pairs])
    wrong = [(d, g, w) for (d, w), g in zip(pairs, got, strict=True) if g != w]
    assert not wrong, wrong
    assert len(pairs) > 60


def test_clean_texts_stay(repair):
    texts = CLEAN + LATIN + MIXED + [" ".join(CLEAN * 50)]
    assert repair(texts) == texts


def test_accents_at_the_start_of_words_are_not_read_as_cyrillic(repair):
    """Read with cp1251 they have no neighbours that could speak for or against it."""
    texts = ["Pachque çaneux et.", "et égal", "à la ça", "Île, ëh", "è", "ça va, à ñu ù"]
    assert repair([misread(t, "utf-8", "latin-1") for t in texts]) == texts
    assert repair(texts) == texts


def test_words_of_accents_are_neither_lost_nor_read_as_cyrillic(repair):
    """Alone they're unlikely as they are, and once each stands for likelier Cyrillic by chance."""
    texts = ["De anque re éè en auxrepa.", "éè", "Und çé berci.", "Los las ñóó.", "Aile, " * 50 + "éè. " * 50]
    assert repair([misread(t, "utf-8", "latin-1") for t in texts]) == texts
    assert repair(texts) == texts


def test_batches_keep_other_texts_and_cut_none(spark):
    texts = [None, "", "plain", misread(CLEAN[0] * 100, "utf-8", "latin-1"), "日本語", "𝄞 é", misread("El niño", "utf-8", "latin-1")] * 3
    want = [None, "", "plain", CLEAN[0] * 100, "日本語", "𝄞 é", "El niño"] * 3
    held = spark.createDataFrame([(i, bytes(t, "utf-8") if t is not None else None) for i, t in enumerate(texts)] + [(99, b"\xff\xc3(")], "i int, b binary")
    got = sorted(held.select("i", M.repaired(F.col("b").cast("string")).cast("binary").alias("b")).collect())
    assert [None if r["b"] is None else r["b"].decode() for r in got[:-1]] == want
    assert bytes(got[-1]["b"]) == b"\xff\xc3("
