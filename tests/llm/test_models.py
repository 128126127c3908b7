import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import language, pair_defects, truncation
from millrace.llm.language import CODES, Model


@pytest.fixture(scope="module")
def samples(spark, sf):
    return [(r.lang, r.sample_text) for r in spark.read.parquet(f"{sf}/language_samples.parquet").orderBy("sample_id").collect()]


@pytest.fixture(scope="module")
def held_out(samples):
    """A model of two thirds of the samples, and the other third."""
    train = [x for i, x in enumerate(samples) if i % 3]
    return Model.train([t for _, t in train], [c for c, _ in train]), [x for i, x in enumerate(samples) if i % 3 == 0]


def segments(model, texts, declared=None):
    n = len(texts)
    said = np.array([CODES.index(d) if d else -1 for d in declared or [None] * n])
    row, number, a, b, lang, conf = language.fuse(model, pa.array(texts, pa.string()), np.full((n, 9), 1 / 9), said)
    out = [[] for _ in texts]
    for r, k, x, y, c, p in zip(row, number, a, b, lang, conf):
        assert k == len(out[r]) and 0 < p <= 1
        out[r].append((CODES[c], texts[r][x:y]))
    return out


def test_language_accuracy(held_out):
    model, test = held_out
    got = segments(model, [t for _, t in test])
    assert np.mean([[c for c, _ in g] == [lang] for g, (lang, _) in zip(got, test)]) > 0.97


def test_mixed_texts(held_out):
    model, test = held_out
    rng = random.Random(4)
    cases = []
    while len(cases) < 150:
        (a, x), (b, y) = rng.sample(test, 2)
        if a != b and len(x) > 40 and len(y) > 40:
            cases.append(([a, b], f"{x}\n{y}"))
    got = segments(model, [t for _, t in cases])
    assert np.mean([[c for c, _ in g] == want for g, (want, _) in zip(got, cases)]) > 0.95
    assert all("".join(s for _, s in g) == t for g, (_, t) in zip(got, cases))


def test_names_and_single_words_make_no_segment(held_out):
    model, test = held_out
    text = next(t for c, t in test if c == "en" and len(t) > 80)
    for extra in ("\n\n— Wenzaca", " Fenvin!", '\nThe label reads “мост”, which puzzles me.', "\n12.", "\n…"):
        assert [c for c, _ in segments(model, [text + extra])[0]] == ["en"], extra
    assert segments(model, ["", "  ", "123 ...", "🎉"]) == [[], [], [], []]


def test_labels(spark):
    labels = ["en", "EN", "en-GB", "eng", "English", "fr_FR.UTF-8", "Français", "deu", "zh-Hans", "中文", "Brazilian Portuguese", "русский", None, "", "?", "und", "xx", "unknown", "nl"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, t string")
    got = [r.c for r in df.select("i", language.declared_code(F.col("t")).alias("c")).orderBy("i").collect()]
    assert got == ["en"] * 5 + ["fr", "fr", "de", "zh", "zh", "pt", "ru"] + [None] * 7


def test_detection_of_wrong_labels(spark, sf, samples):
    by = {}
    for c, t in samples:
        by.setdefault(c, []).append(t)
    pick = lambda c: max(by[c], key=len)
    rows = [(1, pick("en"), "en-GB", "web"), (2, pick("en"), "fr", "web"), (3, pick("de"), None, None), (4, pick("ru") + "\n" + pick("fr"), "ru", "x"), (5, "N/A", "fr", "x"), (6, None, None, "x"), (7, " ", "en", "x"), (8, pick("zh"), "und", "web")]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "id long, t string, lab string, src string, lang string, text string")
    tab = spark.read.parquet(f"{sf}/language_samples.parquet")
    out = language.wrong_or_mixed(language.detect_languages(df, "id", [("t", "lab")], "src", tab), "id")
    assert sorted((r.id, r.seg_no, r.lang) for r in out.collect()) == [(2, 0, "en"), (3, 0, "de"), (4, 0, "ru"), (4, 1, "fr"), (8, 0, "zh")]
    assert language.detect_languages(df.limit(0), "id", [("t", "lab")], "src", tab).count() == 0


def test_priors_are_smoothed(spark):
    df = spark.createDataFrame([("a", "fr")] * 500 + [("b", "en")] * 2 + [("c", None)], "host string, declared string")
    got = {r.host: dict(zip(CODES, r.prior)) for r in language.host_priors(df).collect()}
    assert all(abs(sum(p.values()) - 1) < 1e-9 and min(p.values()) > 0 for p in got.values())
    assert got["a"]["fr"] > 0.9 and got["b"]["fr"] > got["b"]["de"] and got["c"]["fr"] > got["c"]["en"]


SENTENCES = [
    "The old mill by the river grinds flour for the whole valley.", "Nobody in the village remembers when the bridge was built!", "Does the ferry still stop at the northern pier?", "She keeps a ledger of every storm since spring.",
    "Der alte Müller erzählt gern von früher.", "Le vieux moulin tourne encore sous la pluie.", "古老的磨坊还在河边转动。", "Старая мельница стоит у реки.",
]


def stories(n, seed):
    rng = random.Random(seed)
    ends = ["", "", "", "\n\n— Anselm", " 🙂", "\n- one flour sack from Bruno\n- two pails beside the mill", "\n1. a rope\n2. the lantern near the gate", " (See the notes.)"]
    return [" ".join(rng.choice(SENTENCES) for _ in range(rng.randint(2, 7))) + rng.choice(ends) for _ in range(n)]


def test_truncation_on_held_out_cuts():
    w = truncation.train(stories(800, 1), [(0, 0)] * 800)
    texts, _, y = truncation.cut_examples(stories(300, 2), [(0, 0)] * 300, seed=9)
    cps, offs = truncation.cp.from_texts(texts)
    none = np.full(len(texts), -1)
    p = truncation.probability(w, truncation.features(cps, offs, none, none))
    assert np.mean((p >= 0.5) == y) > 0.97


def test_truncation_query(spark):
    rows = []
    for i, t in enumerate(stories(900, 5)):
        rows.append((i, t[:150] if i % 3 == 0 else t, "cut" if i % 3 == 0 else "whole"))
    rows += [(1000, None, "whole"), (1001, "", "cut"), (1002, "n/a", None), (1003, "The old mill by the river gri", None)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "n long, t string, s string, p double")
    hit = {r.n for r in truncation.truncated(df, "n", "t", "s").collect()}
    broken = {i for i, t, s in rows if s == "cut" and len(t) == 150 and t.rstrip()[-1] not in ".!?。" and "\n" not in t and "🙂" not in t and "(See" not in t}
    assert len(broken - hit) <= 0.05 * len(broken) and 1003 in hit and not hit & {1000, 1001, 1002}
    whole = {i for i, _, s in rows if s == "whole"}
    assert len(whole & hit) <= 0.02 * len(whole)
    report = {r.source: r for r in truncation.truncation_report(df, "n", "t", "s").collect()}
    assert report["cut"].n_rows == 301 and report["cut"].share > 0.5 and report["whole"].share < 0.02 and report[None].n_truncated == 1
    assert truncation.truncated(df.limit(0), "n", "t", "s").count() == 0


@pytest.fixture(scope="module")
def tagger(spark, sf, samples):
    lang = Model.train([t for _, t in samples], [c for c, _ in samples], orders=(3,))
    rows = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/instruction_records.parquet").where("winner_prompt IS NOT NULL AND length(response_of_winner_prompt) > 20").collect()
    return pair_defects.train([(r.winner_prompt, r.response_of_winner_prompt) for r in rows if r.line_no % 2], lang, [(t, c) for c, t in samples]), [r for r in rows if r.line_no % 2 == 0]


def defect(model, prompt, response):
    c, tags = pair_defects.tag(model, pa.array([response], pa.string()), pa.array([prompt], pa.string()))
    d = c.defects(tags)[0]
    return None if d < 0 else pair_defects.DEFECTS[d]


def test_defects_made_from_held_out_pairs(tagger):
    model, rows = tagger
    rng = random.Random(8)
    plain = [r for r in rows if r.prompt_lang == "en" and r.response_lang == "en" and len(r.response_of_winner_prompt) > 150 and r.response_of_winner_prompt.rstrip().endswith(".") and " in " in r.winner_prompt and "reply" not in r.winner_prompt and "nswer" not in r.winner_prompt]
    other = [r.response_of_winner_prompt for r in rows if r.response_lang in ("es", "ru", "zh", "de")]
    good = made = 0
    for r in plain[:120]:
        p, a = r.winner_prompt, r.response_of_winner_prompt
        for want, text in (("copy", p), ("copy", p + "\nAnswer:"), ("truncated", a[: int(len(a) * 0.6)].rsplit(" ", 1)[0] + " th"), ("refusal", rng.choice(["I am sorry, I can't do this.", "Unfortunately I must refuse this request."])), ("other_language", rng.choice(other).rstrip("🎉🌱🙂 "))):
            made += 1
            good += defect(model, p, text) == want
    assert good / made > 0.93


def test_decoys_are_answers(tagger):
    model, rows = tagger
    r = next(r for r in rows if r.prompt_lang == "en" and len(r.response_of_winner_prompt) > 200 and r.response_of_winner_prompt.rstrip().endswith("."))
    head = r.winner_prompt.split(". ")[0] + ". "
    for text in (head + r.response_of_winner_prompt, "Dear Anna, I am sorry that the kettle came late and cannot be returned. " + r.response_of_winner_prompt):
        assert defect(model, r.winner_prompt, text) is None
    spanish = "El viejo molino del río muele harina para todo el valle. Nadie recuerda cuándo se construyó el puente."
    assert defect(model, r.winner_prompt, spanish) == "other_language"
    assert defect(model, r.winner_prompt + " Answer in Spanish.", spanish) is None
    assert defect(model, "", spanish) is None and defect(model, None, spanish) is None


def test_pair_defects_edges(spark, sf):
    rows = spark.read.parquet(f"{sf}/instruction_records.parquet").select(F.lit("t").alias("tab"), F.col("line_no").alias("row_key"), F.col("winner_prompt").alias("prompt"), F.col("response_of_winner_prompt").alias("response"))
    extra = spark.createDataFrame([("x", 1, "q", None), ("x", 2, None, ""), ("x", 3, "q", " N/A "), ("x", 4, None, "The mill grinds flour for the valley."), ("x", 5, "q", "​"), ("x", 6, "q", "word " * 50_000 + "end.")], "tab string, row_key long, prompt string, response string")
    out = pair_defects.pair_defects(rows.unionByName(extra).withColumn("defect", F.lit("clash")), spark.read.parquet(f"{sf}/language_samples.parquet"))
    got = {(r.tab, r.row_key): r.defect for r in out.collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "x" and k[1] != 6} == {1: "empty", 2: "empty", 3: "empty", 5: "empty"}
    assert len(got) == out.count()
    assert pair_defects.pair_defects(rows.limit(0), spark.read.parquet(f"{sf}/language_samples.parquet")).count() == 0


def test_suffixes(spark):
    texts = ["https://www.example.de/path?x=1", "example.com.br", "de-AT", "fr_FR.UTF-8", "example.com", "en", None, ""]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string")
    got = [r.c for r in df.select("i", language.suffix_code(F.col("t")).alias("c")).orderBy("i").collect()]
    assert got == ["de", "pt", "de", "fr", None, None, None, None]


def test_suffix_decides_only_where_the_text_does_not(held_out):
    model, test = held_out
    prior, none = np.full((1, 9), 1 / 9), np.array([-1])
    fr = np.array([CODES.index("fr")])
    lang = lambda t, s: language.fuse(model, pa.array([t]), prior, none, s)[4].tolist()
    assert lang("Qqq xxyyq", fr) == [CODES.index("fr")]
    english = next(t for c, t in test if c == "en")
    assert set(lang(english, fr)) == {CODES.index("en")}


def test_tails_of_long_last_lines_and_long_blanks():
    import numpy as np

    from millrace.llm import codepoints as cp
    from millrace.llm import truncation

    long = "word " * 80 + "end"
    texts = ["- " + long, "3) " + long, "Intro\n* " + long, "x" * 300 + "\n" + long, "Done here." + " " * 400, "x" * 191 + "- " + long[-190:]]
    mat, kind = truncation.tails(*cp.from_texts(texts))
    short, wanted = truncation.tails(*cp.from_texts(["- word end", "3) word end", "Intro\n* word end", "word end", "Done here.", "x" * 9 + "- word end"]))
    assert kind.tolist() == wanted.tolist() and kind[1] == 2 and kind[2] == 1
    assert np.array_equal(mat[4], short[4])


#: Refusals worded apart from the grammar and from the tables.
HELD_OUT = {
    "en": ["I'm not willing to write that, sorry.", "Helping with this is not possible for me.", "I am afraid this one has to be declined by me.", "My instructions stop me from answering you.", "I really can't assist you in this matter.", "Sorry, I am not allowed to go on with this."],
    "es": ["Disculpe, no estoy autorizado a contestar.", "No puedo ayudarte con este texto, lo siento.", "Mis reglas prohíben hablar de este tema."],
    "fr": ["Pardon, je ne suis pas en mesure de vous aider.", "Je refuse de répondre à cette question.", "Mes règles m'interdisent de continuer."],
    "de": ["Ich darf diese Frage leider nicht beantworten.", "Dabei kann ich Ihnen nicht weiterhelfen.", "Meine Regeln verbieten es mir zu antworten."],
    "it": ["Mi spiace, non sono in grado di aiutarti.", "Non posso rispondere alla tua domanda.", "Le mie regole mi vietano di continuare."],
    "pt": ["Desculpe, não posso responder à sua pergunta.", "Não me é permitido ajudar com isso.", "As minhas regras não deixam continuar."],
    "ru": ["Простите, я не могу вам ответить.", "Мне запрещено говорить на эту тему.", "Я отказываюсь выполнять это задание."],
    "ar": ["عذرا، لا يمكنني الإجابة عن هذا السؤال.", "لا يسمح لي بمناقشة هذا الموضوع.", "أرفض القيام بهذه المهمة."],
    "zh": ["抱歉，我无法回答您的问题。", "我不能继续讨论这个话题。", "我拒绝完成这项任务。"],
}


@pytest.fixture(scope="module")
def small_tagger(samples):
    by = {}
    for c, t in samples:
        by.setdefault(c, []).append(t)
    rng = random.Random(8)
    pairs = []
    for _ in range(700):
        c = rng.choice(["en"] * 5 + list(CODES))
        pairs.append((" ".join(rng.sample(by[c], 2)), " ".join(rng.sample(by[c], rng.randint(1, 3)))))
    return pair_defects.train(pairs, Model.train([t for _, t in samples], [c for c, _ in samples], orders=(3,)), [(t, c) for c, t in samples]), by


def defects_of(model, pairs):
    c, tags = pair_defects.tag(model, pa.array([r for _, r in pairs], pa.large_string()), pa.array([p for p, _ in pairs], pa.large_string()))
    return [pair_defects.DEFECTS[i] if i >= 0 else None for i in c.defects(tags)]


def test_refusals_of_other_wording(small_tagger):
    model, by = small_tagger
    rng = random.Random(9)
    pairs = [(" ".join(rng.sample(by[c], 2)), r) for c, rs in HELD_OUT.items() for r in rs for _ in range(3)]
    got = defects_of(model, pairs)
    assert np.mean([d == "refusal" for d in got]) >= 0.9, [x for x, d in zip(pairs, got) if d != "refusal"]
    answers = [(" ".join(rng.sample(by[c], 2)), " ".join(rng.sample(by[c], 2))) for c in CODES for _ in range(20)]
    assert np.mean([d == "refusal" for d in defects_of(model, answers)]) <= 0.02


def test_seeds_do_not_stand_in_the_tables(spark, sf):
    """No whole refusing sentence of the grammar, nor an answer that sounds like one, is a sentence of the test tables."""
    from millrace.llm import refusals

    texts = [r.t for r in spark.read.parquet(f"{sf}/instruction_records.parquet").selectExpr("response_of_winner_prompt AS t").unionByName(spark.read.parquet(f"{sf}/model_responses.parquet").selectExpr("response AS t")).where("t IS NOT NULL").distinct().collect()]
    known = "\n".join(texts).lower()
    for *_, wholes in refusals.DECLINE.values():
        for whole in wholes.split("|"):
            assert len(whole.split()) < 3 and len(whole) > 1 or whole.lower() not in known, whole


def test_a_tenth_language(spark, samples):
    dutch = ["De oude molen bij de rivier maalt meel voor het hele dal.", "Niemand in het dorp weet nog wanneer de brug werd gebouwd.", "Vaart het veer nog steeds naar de noordelijke steiger?", "Zij houdt sinds het voorjaar een lijst bij van elke storm."]
    tab = spark.createDataFrame([*samples, *(("nl", t) for t in dutch * 5)], "lang string, sample_text string")
    df = spark.createDataFrame([(1, "De brug bij het oude dorp werd in het voorjaar gebouwd.", "nl-BE"), (2, "Niemand weet nog van elke storm bij de molen.", "en")], "id long, t string, lab string")
    out = {r.id: (r.declared, r.segments[0].lang) for r in language.detect_languages(df, "id", [("t", "lab")], "lab", tab).collect()}
    assert out == {1: ("nl", "nl"), 2: ("en", "nl")}


def test_truncation_without_any_text(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "n long, t string, s string")
    assert truncation.truncated(df, "n", "t", "s").count() == 0
    assert {(r.source, r.n_rows, r.n_truncated) for r in truncation.truncation_report(df, "n", "t", "s").collect()} == {("a", 1, 0), (None, 1, 0)}


def test_detector_of_the_preprocessing_plan(spark, sf):
    from millrace.plans import preprocess

    df = spark.read.parquet(f"{sf}/instruction_records.parquet")
    with_it, audit = preprocess.run(df, detector=language.prompt_detector(spark, sf))
    without, _ = preprocess.run(df)
    n = lambda rows: rows.where("skip_reason = 'language'").count()
    assert n(with_it) > 0 and n(without) == 0 and with_it.count() == without.count() and audit.count() > 0
