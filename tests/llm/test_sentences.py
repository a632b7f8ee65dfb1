import pytest

from factloom.llm.sentences import request_texts, sentence_ends, sentences


def cut(text):
    out, start = [], 0
    for e in sentence_ends(text):
        out.append(text[start:e].strip())
        start = e
    return out


@pytest.mark.parametrize(
    "parts",
    [
        ["Dr. Ana Bell weighed 5.57 g, i.e. about $5.57 of flax.", "See Fig. 5 and Sec. 5.7 on Lo Works vs. Mira (cf. Ann and Bo)."],
        ["They reached it by 5 p.m.", "Each week 5 jars go by 9 a.m. to Lo Ltd.", "kv12.5 is how they tag tin."],
        ['"Stop the line!" Ana Bell told Bo.', 'Bo wrote: "The jars are late."', "“Is it open yet?” Ana asked Bo."],
        ["What does Ana keep? is a list by Bo.", "Ana waited ... and then sold jars!", "Did Ana go?!"],
        ["Am 3. März 1815 eröffneten sie die Firma.", "„Wer liefert das?“, fragte Ana.", "Ana rief: „Komm her, Bo!“", "Er hat z. B. 7 Siebe, d. h. ca. 3,5 Pfund."],
        ["« Qui livre Ana ? » demanda Bo.", "Ana cria : « Viens vite, Bo ! »", "M. Bo ouvrit en 1888, cf. p. 51."],
        ["«¿Llegaron?», preguntó Ana.", "¡Ana ya no enseña!", "El lote núm. 34, p. ej. de Bo, pesó 7,5 kg."],
        ["«Кто возит?» — спросил Иван.", "А. Б. Орлов открыл дом в 1865 г. в Туле.", "У г. Орлова 5 станков, т. е. 7,5 кг."],
        ["عند د. سامي نحو 62.17 كغ.", "«أين سامي؟» سأل نور.", "هل يورد سامي؟"],
        ["डॉ. राम के पास 5.5 किलो हैं।", '"कौन देता है?" राम ने पूछा।', "क्या राम ने छोड़ दिया?"],
    ],
)
def test_spaced_scripts(parts):
    assert cut(" ".join(parts)) == parts


def test_scripts_without_spaces():
    zh = ["“谁给他送货？”王明在城里问道。", "李华说：“他明天来。”", "等了很久……终于买到7件铁砧！", "385年他来了。"]
    ja = ["太郎は「花子が来た。」と言った。", "「届いたか？」と太郎は尋ねた。", "本当に904個か！？", "No.798の札は1.40キロだ。"]
    assert cut("".join(zh)) == zh
    assert cut("".join(ja)) == ja
    th = ["โลโตมีโถอยู่5ชิ้น", "เรเรถามว่า“ใครส่งของ?”ที่โนรี", "สูโนซื้อดีบุกหนัก4.5กก.ในปี1878"]
    assert cut(" ".join(th)) == th


def test_blank_lines_breaks_and_edges():
    assert cut("A heading\n\nFirst line\ngoes on. Second\n \nthird") == ["A heading", "First line\ngoes on.", "Second", "third"]
    assert cut("Glued.Then next.") == ["Glued.", "Then next."]
    assert cut("Sold to Lo Works Ltd.Ana came by 5 p.m.Bo left.") == ["Sold to Lo Works Ltd.", "Ana came by 5 p.m.", "Bo left."]
    assert cut("J.K. Bell of the U.S.A. met Bo, e.g. here.") == ["J.K. Bell of the U.S.A. met Bo, e.g. here."]
    assert cut("He said no. Then he left for art. See Nr. 5 and no. 7 there.") == ["He said no.", "Then he left for art.", "See Nr. 5 and no. 7 there."]
    assert cut("They left the U.S.A. Bo stayed.") == ["They left the U.S.A.", "Bo stayed."]
    assert cut("two  spaces  inside stay") == ["two  spaces  inside stay"]
    assert cut("no end inside") == ["no end inside"]
    assert sentence_ends(None) == sentence_ends("") == sentence_ends(" \n\t ") == []
    assert sentence_ends("  Hi. ") == [5]
    long = "Ann met Bob. " * 50_000
    assert len(sentence_ends(long)) == 50_000
    assert len(sentence_ends('"' + "a.b. " * 100_000)) >= 1
    assert len(sentence_ends("(" * 100_000 + ". ")) == 1


def test_abbreviations_are_those_of_the_language():
    for two in ("The rod is 5 mm. The tube is 7 cm.", "It took 1 hr. Then it stopped.", "Длина 5 см. Затем он ушёл.", "He lives on Main St. She left.", "We met the rep. He smiled."):
        assert len(cut(two)) == 2, two
    one = ("We met Gigemus Lalere St. Tosik there.", "Mme Roy et MM. Bel et Noir sont dans la salle.", "Das ist der Hof von Hr. Meier und Fr. Huber.", "El libro es de la sra. López y del sr. García.", "См. рис. 5 и табл. 7.", "M. Tonanux Nanisu garde env. 27,91 kg.")
    for text in one:
        assert len(cut(text)) == 1, text


def test_time_is_linear_in_stray_brackets():
    import time

    began = time.time()
    sentence_ends("( a. b " * 30_000)
    sentence_ends("“ a. b „ c. [ d? " * 20_000)
    assert time.time() - began < 10
    deep = "(" * 50 + "One. Two." + ")" * 50 + " Three. Four."
    assert cut(deep) == [deep[: deep.index(" Three")], "Three.", "Four."]


def test_operator(spark):
    rows = [(1, 1, ["One. Two.", None, "  "]), (1, 1, ["One. Two.", None, "  "]), (2, 1, None), (3, 1, [])]
    df = spark.createDataFrame(rows, "request_id long, setting_id int, texts array<string>")
    got = sentences(request_texts(df), "text", ["request_id", "text_no"]).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 4), (1, 0, 0, 4), (1, 0, 1, 9), (1, 0, 1, 9)]
    assert sentences(request_texts(df.limit(0)), "text", ["request_id"]).count() == 0
