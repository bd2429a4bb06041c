import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import encoding, pages, sentences

CLEAN = [
    "Le comité a validé la rénovation des chaudières dès le début de l’année 2023.",
    "Größere Änderungen gab es durch die Stilllegung zweier Öfen in Kötzberg.",
    "AVALIAÇÃO CONCLUÍDA: as leituras estão completas. São Velmo poupa água.",
    "Основной причиной стало внедрение новых счётчиков. Проверка не выявила отклонений.",
    "The permit limit of 38 m³ was met — “We met the target,” said Velsund’s manager at 15 °C.",
    "Zużycie energii w zakładzie spadło, ponieważ zmieniono kotły. Żaden zakład nie przekroczył limitu.",
    "用水量比上年下降了。主要原因是循环利用冷却水。",
    "エネルギー消費量は推計値である。主な要因は冷却水の再利用である。",
]


@pytest.fixture(scope="module")
def model(spark):
    texts = spark.createDataFrame([(i, t) for i in range(60) for t in CLEAN], "i int, text string")
    return encoding.train(texts)


@pytest.mark.parametrize(("text", "written", "read"), [(0, "utf-8", "cp1252"), (1, "utf-8", "latin-1"), (2, "utf-8", "mac_roman"), (4, "utf-8", "cp437"), (3, "utf-8", "cp1251"), (3, "cp1251", "latin-1"), (3, "koi8-r", "cp1251"), (5, "utf-8", "cp1250"), (6, "gbk", "latin-1"), (7, "cp932", "latin-1"), (6, "utf-8", "latin-1")])
def test_encoding_round_trip(model, text, written, read):
    garbled = CLEAN[text].encode(written, "ignore").decode(read, "replace")
    restorer = encoding.Restorer(model)
    restorer.learn([garbled])
    restored, changed, _ = restorer.restore(garbled)
    expected = CLEAN[text].encode(written, "ignore").decode(written)
    same = sum(a == b for a, b in zip(restored, expected, strict=False)) / len(expected)
    assert changed and same > 0.9, restored


def test_encoding_twice_and_clean(model):
    twice = CLEAN[0].encode().decode("cp1252").encode().decode("cp1252")
    restorer = encoding.Restorer(model)
    restorer.learn([twice, *CLEAN, "m�", None, "", "plain"])
    assert restorer.restore(twice)[0] == CLEAN[0]
    assert all(restorer.restore(t) == (t, 0, 0) for t in CLEAN)
    assert restorer.restore("m�")[1:] == (0, 1)
    assert restorer.restore(None) == (None, 0, 0) and restorer.restore("plain") == ("plain", 0, 0)


WHOLE = [
    (3, "Проверка с\xa0отклонений и\xa0выявила — а причиной в 2020 г. стало внедрение. "),
    (5, "Zużycie w zakładzie, ó i ę: limitu żaden zakład nie przekroczył. "),
    (1, "Änderungen gab es über Öfen. "),
]


@pytest.mark.parametrize(("which", "written", "read"), [(0, "cp1251", "cp1252"), (0, "koi8-r", "cp1252"), (0, "cp1251", "koi8-r"), (0, "cp866", "cp1251"), (0, "cp1251", "mac_roman"), (0, "cp1251", "latin-1"), (1, "cp1250", "cp1252"), (1, "iso8859-2", "cp1252"), (1, "cp852", "cp1250"), (2, "cp1252", "mac_roman"), (2, "cp1252", "cp850"), (2, "mac_roman", "cp1252")])
def test_encoding_whole_texts_by_one_chain(model, which, written, read):
    at, more = WHOLE[which]
    true = (CLEAN[at] + " " + more).encode(written, "ignore").decode(written)
    garbled = "".join(bytes([b]).decode(read, "ignore") or chr(b) for b in true.encode(written))
    restorer = encoding.Restorer(model)
    assert restorer.restore(garbled, restorer.learn([garbled])[0])[0] == true


def test_encoding_leaves_the_sound_part(model):
    half = CLEAN[3] + " " + CLEAN[0].encode("cp1252").decode("mac_roman")
    restorer = encoding.Restorer(model)
    restorer.learn([half])
    assert restorer.restore(half)[0].startswith(CLEAN[3])


def test_encoding_tables(spark, model):
    rows = [(1, None), (2, ""), (3, "mÂ³ and nothing else"), (4, CLEAN[0]), (5, "x" * 200_000), (6, "lost �")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "doc long, text string, id string")
    found = {r["doc"]: r for r in encoding.restore_texts(frame, "doc", "text", model).collect()}
    assert set(found) == {3, 6} and found[3]["restored"].startswith("m³")
    assert encoding.restore_texts(frame.limit(0), "doc", "text", encoding.train(frame.limit(0))).count() == 0


def test_encoding_copies_of_a_misread_text(spark):
    garbled = CLEAN[3].encode("cp1251").decode("cp1252")
    texts = spark.createDataFrame([(i, f"{t} {chr(97 + i)}") for i in range(26) for t in CLEAN] + [(i, garbled) for i in range(400)], "i int, text string")
    restorer = encoding.Restorer(encoding.train(texts))
    restorer.learn([garbled, *CLEAN])
    assert restorer.restore(garbled)[0] == CLEAN[3]
    assert all(restorer.restore(t) == (t, 0, 0) for t in CLEAN)


def test_encoding_many_different_misread_texts(spark):
    import random

    rng = random.Random(6)
    vocabulary = "основной причиной стало внедрение новых счётчиков проверка не выявила отклонений завод сократил потребление воды энергии выбросы отчёт учтены данные уровень показатель снизился".split()
    sentence = lambda: " ".join(rng.choices(vocabulary, k=40))
    sound, meant = [sentence() for _ in range(160)], [sentence() for _ in range(40)]
    garbled = [t.encode("cp1251").decode("cp1252") for t in meant]
    restorer = encoding.Restorer(encoding.train(spark.createDataFrame([(t,) for t in sound + garbled], "text string")))
    read = [restorer.restore(t, runs)[0] for t, runs in zip(garbled, restorer.learn(garbled), strict=True)]
    assert sum(a == b for a, b in zip(read, meant, strict=True)) >= 38
    assert all(restorer.restore(t, runs)[0] == t for t, runs in zip(sound, restorer.learn(sound), strict=True))


def test_encoding_margin_depends_on_texts_alone(spark):
    assert encoding.validated_margin({0: 900}) == encoding.LEAST_MARGIN
    assert encoding.validated_margin({0: 900, 67: 1}) == 6.8
    assert encoding.validated_margin({0: 1500, 67: 1, 90: 1}) == 6.8 and encoding.validated_margin({0: 2000, 130: 9}) == encoding.MOST_MARGIN
    texts = spark.createDataFrame([(f"{t} {chr(97 + i % 26)}{chr(97 + i // 26)}",) for i in range(60) for t in CLEAN], "text string")
    first = encoding.train(texts)
    by_layout = []
    for laid in (texts.coalesce(1), texts.unionAll(texts).repartition(7)):
        rows = encoding._passed(encoding.different_texts(laid, held_out=True).select("text"), first, first).collect()
        by_layout.append((sum(r["n"] for r in rows), encoding.train(laid).margin))
    assert by_layout[0] == by_layout[1] and by_layout[0][0] > 10


# Each | marks an end of a sentence.
MARKED = [
    "Is 20% enough?!| The council thinks so.|",
    "Version 2.10.1 was used... and then dropped.| 25.13 million m³ were drawn (see Fig. 9).|",
    "Sec. 12.19.8 covers waste; see Table No. 6 on p. 7, cf. Annex B, for it.| Dr. Mavrune signed on 5 Sept. 2014.| How far?|",
    "\"Did it help?\" the board asked.| \"It did,\" said the works’s manager.|",
    "The board noted that “leak detection came late.”| The main driver was it.|",
    "“We met the target. We will raise it again,” the chair said in 2020.| Prof. K wrote, “Wait for logs!”, and Acme did.|",
    "Acme Corp. closed both mills at 15 p.m.| Renewable supply fell, etc.| eNova units cut it by 11%.|",
    "Acme (formerly Ardmere Co.) sold it in Dec. 2017.| Acme Inc. and Ardmere Ltd. share the U.S. sites.|",
    "Performance data\n\nThe ratio was 0.24.|\n\n| 2018 | 2019 |\n| 12.2 | 2,972 |\n\nIt rose.|\n54",
    "Am 19. März 2018 wurde z. B. ein Zähler beschlossen, vgl. Kap. 11.26.| Dr. Dolvik sagte: „Das Ziel ist erreicht. Wir erhöhen es.“|",
    "„Ist es vollständig?“, fragte die Prüferin.| Zuletzt am 14. 12. 2020.|",
    "M. Mavrune a demandé : « Est-elle complète ? »| En 2024, env. 31 tonnes, c.-à-d. 42 % de moins.|",
    "« Le but est atteint. Nous irons plus loin », a déclaré Mme Tessarin.|La consommation baisse.|",
    "¿Y qué pasó en 2020?| EE. UU. y Villa suman 4 según el Dr. Ostrelli.| ¡No se superó!|",
    "Завод в г. Дростень выбросил 71,7 тыс. т за 2008 г.| В отчёте учтены вода, пар и т. д.| Потребление ок. 5 ГВт·ч.|",
    "«Цель достигнута. Мы её повысим», — сообщила г-жа Кестранд.|",
    "Wskaźnik spadł w grudniu 2014 r. w całej grupie.| Zob. tab. nr 15 na s. 22 oraz zał. C.| Koniec.|",
    "用水量约为596兆瓦时（见表22。单位：万立方米）。|“用水量是否完整？”审计人员问道。|负责人表示：“目标已经完成。我们将继续提高。”|2021年数据。|",
    "「廃棄物量は完全か？」と監査人は尋ねた。|委員長は「達成した。さらに引き上げる。」と述べた。|",
    "डॉ. केस्त्रन ने कहा, “लक्ष्य पूरा हुआ। हम इसे बढ़ाएँगे।”| तालिका सं. 3, पृ. 4 देखें।|",
    "The plant used approx.",
    "Orvkoven Oil Corp.",
    "",
]


@pytest.mark.parametrize("marked", MARKED)
def test_sentences(marked):
    text = marked.replace("|\n", "\x00\n").replace("| ", "\x00 ") if "| 2018" not in marked else marked.replace(".|", ".\x00")
    if "| 2018" not in marked:
        text = text.replace("|", "\x00")
    expected, plain = [], ""
    for c in text:
        if c == "\x00":
            expected.append(len(plain))
        else:
            plain += c
    assert sentences.sentence_ends(plain) == expected


def test_thai_and_tables(spark):
    a, b = "ข้อมูลปีก่อนได้รับการแก้ไขแล้ว", "หน่วยงานใช้น้ำ 36,049 ลบ.ม. ต่อเดือน"
    frame = spark.createDataFrame([(1, f"{a} {b}", "x"), (2, None, "x"), (3, "", "x"), (4, "One. Two", "x")] + [(10 + i, t[:8] + x + t[8:], "x") for i, x in enumerate(("", "ก", "ข", "ค")) for t in (a, b)], "id long, text string, end_pos string")
    thai = sentences.learn_thai(frame.select("text", F.lit(True).alias("whole")))
    rows = sentences.split_documents(frame, "id", "text", thai).collect()
    assert [(r["start_pos"], r["end_pos"]) for r in rows if r["id"] == 1] == [(0, len(a)), (len(a), len(a) + 1 + len(b))]
    assert [(r["end_pos"], r["text"]) for r in rows if r["id"] == 4] == [(4, "One."), (None, "Two")]
    assert not [r for r in rows if r["id"] in (2, 3)]
    assert sentences.split_documents(frame.limit(0), "id", "text", sentences.learn_thai(frame.limit(0).select("text", F.lit(True).alias("whole")))).count() == 0


def test_thai_edges_don_t_depend_on_copies(spark):
    paragraphs = [f"{b}{x}{e}" for b in ("ข้อมูล", "หน่วยงาน") for x in ("หนึ่งและทั้งหมดในปี", "สองและทั้งหมดในปี", "สามและทั้งหมดในปีก่อน") for e in ("แล้ว", "เดือน")]
    copied = [("บริษัทลดการใช้น้ำทั้งหมดใหม่",)] * 900
    learn = lambda rows: sentences.learn_thai(spark.createDataFrame(rows, "text string").withColumn("whole", F.lit(True)))
    alone, crowded = learn([(p,) for p in paragraphs]), learn([(p,) for p in paragraphs] + copied)
    assert alone == crowded and "ข้อมู" in alone.beginnings and "แล้ว" in alone.endings and "บริษั" not in crowded.beginnings


def test_sentences_of_several_scripts(spark):
    a, b = "ข้อมูลปีก่อนได้รับการแก้ไขแล้ว", "หน่วยงานใช้น้ำ 36,049 ลบ.ม. ต่อเดือน"
    frame = spark.createDataFrame([(t[:8] + x + t[8:],) for x in ("", "ก", "ข", "ค") for t in (a, b)], "text string")
    thai = sentences.learn_thai(frame.withColumn("whole", F.lit(True)))
    english = "This is the English one. This is two."
    assert sentences.all_ends(f"ข้อมูลสิ่งแวดล้อม\n{english}", thai) == [18 + 24, 18 + 37]
    mixed = f"{a} {b}\n\n{english}\n{a}"
    at = len(a) + len(b) + 3
    assert sentences.all_ends(mixed, thai) == [len(a), len(a) + 1 + len(b), at + 24, at + 37, len(mixed)]


@pytest.mark.parametrize(
    "marked",
    [
        "Items:\n1. First item is here.|\n2. Second one is, too.|\n3. Third.|",
        "We did this:\na. It was read.|\n   i. By us.|\n   ii. By them.|\nb. It was kept.|\nc. Nothing else.|",
        "Complete.|\n1) One (and so on.|\n2) Two “of them.|\n3) Three.|",
        "A list of\n1. water and\n2. gas.|\nThe limit was\n35.| The council agreed.|",
        "4. The fourth item.|\n5. The fifth.|\nIn all there are\n7.| No more.|",
        "• One.|\n• Two.|\n- Three.|",
    ],
)
def test_list_levels(marked):
    parts = marked.split("|")
    places = [sum(map(len, parts[: i + 1])) for i in range(len(parts) - 1)]
    assert sentences.sentence_ends("".join(parts)) == places


def test_marks_are_matched_whatever_lies_between():
    inner = "It was read. It was kept. " * 40
    assert sentences.sentence_ends(f"The plant (see: {inner}) closed. Next.") == [len(inner) + 25, len(inner) + 31]
    assert sentences.sentence_ends(f"He said “{inner}” and left. Next.") == [len(inner) + 20, len(inner) + 26]
    assert len(sentences.sentence_ends(f"One (two. Three.\n\n{inner}")) == 82


def test_long_text_is_linear():
    text = "The plant used 5 MWh. " * 20_000
    assert len(sentences.sentence_ends(text)) == 20_000
    assert len(sentences.sentence_ends("He said (see p. 7) “no.” In 2020 it fell by 7. " * 20_000)) == 40_000
    assert len(pages.broken_forms("x-\ny" * 20_000)) < 10
    assert pages.label_lines("1 2 3 " * 50_000 + "x\ny", "a", False, None, None, pages.prior_model())[0][0] == "body"


PAGE = "page_id long, report_id long, company string, page_pos int, page_num int, text string"
SNIPPET = "extraction_id long, company string, source_snippet string"


def test_pages(spark):
    body = "The works council reviewed renewable supply and approved the heat-recovery retrofit.\nWater returned at the works met the permit limit of 35 days."
    rows = [(1, 1, "acme_oil", 0, 1, f"Acme Oil\nAnnual Review 2020\n{body}")]
    rows += [(10 + i, 1, "acme_oil", i + 1, i + 2, f"Acme Oil | Annual Review 2020\n{body}\n{i + 42}") for i in range(40)]
    rows += [(60, 2, "other", 0, 1, f"Other\nAnnual Review 2021\n{body}"), (61, 2, "other", 1, 2, "The works coun-\ncil met the per-\nmit limit."), (62, 2, "other", 2, 3, "The heat-\nrecovery retrofit and w@ter returned."), (63, 2, "other", 3, 4, None), (64, 2, "other", 4, 5, ""), (65, 2, "other", 5, 6, "| 2019 | 2020 |\n| 5 | 6 |\nThe works met it.\n917,231\n33.4")]
    snippets = [(1, "Acme-Oil ", f"table@page 3: Water returned | {i}") for i in range(30)] + [(2, "acme oil", "[64]\ntable@page 3: Water returned | 5\nACME OIL"), (3, None, None)]
    found = pages.find_noise(spark.createDataFrame(rows, PAGE).withColumn("what", F.lit(1)), spark.createDataFrame(snippets, SNIPPET))
    got = {(r["src"], r["row_id"], r["kind"]) for r in found.collect()}
    expected = {("report_pages", 10 + i, k) for i in range(40) for k in ("header", "page_number")}
    expected |= {("report_pages", 61, "hyphen"), ("report_pages", 62, "character"), ("extractions", 2, "header"), ("extractions", 2, "page_number")}
    assert got == expected
    texts = {(r["src"], r["row_id"]): r["text"] for r in pages.repair(spark.createDataFrame(rows, PAGE), spark.createDataFrame(snippets, SNIPPET)).collect()}
    assert texts["report_pages", 61] == "The works council met the permit limit."
    assert texts["report_pages", 62].startswith("The heat-recovery") or "heat- recovery" in texts["report_pages", 62]
    assert "and water returned" in texts["report_pages", 62] and texts["report_pages", 10].startswith("The works council")


def test_vocabulary_counts_copies_once(spark):
    words = ["water", "winter", "waste", "wells"]
    sound = [(f"{' '.join(words)} {chr(97 + i // 26)}{chr(97 + i % 26)}",) for i in range(60)]
    wrong = [(" ".join(w.replace("w", "vv") for w in words),)]
    found = pages.misreadings(pages.vocabulary(spark.createDataFrame(sound + wrong * 40, "text string")))
    assert {(r["word"], r["meant"]) for r in found.collect()} >= {("vv" + w[1:], w) for w in words}


def test_breaks_don_t_speak_for_themselves(spark):
    page = lambda i, t: (i, i, "acme", 1, 1, t)
    rows = [page(i, f"It is well and {'long-term' if i % 2 else 'established'} here, row {i}.") for i in range(60)]
    rows += [page(100, "A well-\nestablished plan."), page(101, "A long-\nterm plan."), page(102, "An estab-\nlished plan."), page(103, "A zymo-\ntechnic plan."), page(104, "Soft estab\u00ad\nlished one.")]
    frame, none = spark.createDataFrame(rows, PAGE), spark.createDataFrame([], SNIPPET)
    assert {r["row_id"] for r in pages.find_noise(frame, none).where("kind = 'hyphen'").collect()} == {102, 103, 104}
    texts = {r["row_id"]: r["text"] for r in pages.repair(frame, none).collect()}
    assert [texts[i] for i in range(100, 105)] == ["A well-established plan.", "A long-term plan.", "An established plan.", "A zymotechnic plan.", "Soft established one."]


def test_notation_is_no_misreading(spark):
    rows = [(f"co2e of CO2e and will be {chr(97 + i)} water",) for i in range(26)] * 1 + [("CO₂ of old, 5co2e, wi1l b@e w@ter and wat3r",), ("w@ste w@lls w@ys",)]
    rows += [(f"waste walls ways {chr(97 + i)}",) for i in range(26)]
    found = {r["word"]: r["meant"] for r in pages.misreadings(pages.vocabulary(spark.createDataFrame(rows, "text string"))).collect()}
    assert "co₂" not in found and "5co2e" not in found
    assert found["w@ter"] == "water" and found["w@ste"] == "waste"


def test_planted_scan_noise_is_repaired(spark):
    rng = np.random.default_rng(5)
    vocabulary = ["water", "energy", "company", "period", "waste", "target", "measured", "reported", "emissions", "premises"]
    clean = [" ".join(rng.choice(vocabulary, 24)).capitalize() + "." for _ in range(160)]
    rows, true = [], {}
    for i, text in enumerate(clean):
        w = text.split(" ")
        page = [" ".join(w[:8]), " ".join(w[8:16]), " ".join(w[16:])]
        if i % 4 == 1:
            page[0], page[1] = page[0][:-2] + "-", page[0][-2:] + " " + page[1]
        if i % 4 == 2:
            page[1] = page[1].replace("m", "rn", 1)
        if i % 4 == 3:
            page = ["Acme Oil | Annual Review 2020", *page, f"- {i + 7} -"]
        if i % 8 == 0:
            page.insert(1, "")
        rows.append((i, i // 40, "acme_oil", 1 + i % 40, 1 + i % 40, "\n".join(page)))
        true[i] = text
    rows += [(900 + k, k, "acme_oil", 0, 0, f"Acme Oil\nAnnual Review 2020\n{clean[0]}") for k in range(4)]
    found = {r["row_id"]: r["text"] for r in pages.repair(spark.createDataFrame(rows, PAGE), spark.createDataFrame([], SNIPPET)).collect()}
    right = sum(found[i] == true[i] for i in true)
    assert right >= 0.95 * len(true), [(found[i], true[i]) for i in true if found[i] != true[i]][:3]


def test_pages_empty(spark):
    assert pages.find_noise(spark.createDataFrame([], PAGE), spark.createDataFrame([], SNIPPET)).count() == 0


def test_viterbi_against_brute_force():
    from itertools import product

    rng = np.random.default_rng(3)
    model = pages.LineModel(np.log(rng.dirichlet(np.ones(6))), np.log(rng.dirichlet(np.ones(6), 6)), np.log(rng.dirichlet(np.ones(36), 6)))
    for _ in range(5):
        o = [int(x) for x in rng.integers(0, 36, 4)]
        score = lambda p, o=o: model.start[p[0]] + model.emit[p[0], o[0]] + sum(model.move[a, b] + model.emit[b, x] for a, b, x in zip(p, p[1:], o[1:], strict=False))
        assert tuple(pages.viterbi(o, model)) == max(product(range(6), repeat=4), key=score)


def test_paths_of_many_at_once():
    rng = np.random.default_rng(4)
    states, kinds = len(pages.STATES), len(pages.KINDS) * len(pages.EDGES)
    model = pages.LineModel(np.log(rng.dirichlet(np.ones(states))), np.log(rng.dirichlet(np.ones(states), states)), np.log(rng.dirichlet(np.ones(kinds), states)))
    sequences = [[int(x) for x in rng.integers(0, kinds, n)] for n in [*rng.integers(1, 30, 60), 1, pages.MANY_LINES, 700]]
    pages._paths.learn(sequences, model)
    assert all(pages._paths.known[tuple(o)] == pages._paths._best(tuple(o)) for o in sequences if len(o) <= pages.MANY_LINES)
    assert len(pages.viterbi(sequences[-1], model)) == 700
