import pytest

from quire.llm import queries, sentences

SCHEMA = "block_id bigint, kind string, source string, lang string, text string, row string, word int"
#: Unambiguous occurrences that the documents below learn from.
LESSONS = [
    ("en", ["We cite app. b, sec. 8 and Fig. 3, read by Rastavi and Dremov.", "It ends in app. B.", "We note the proof, the cone, etc.", "At last we see Dr. Orvath.", "by the way, the file is at home.", "It stops at 4 p.m.", "Then it stops.", "Eq. 4 and Prof. Orvath agree."]),
    ("de", ["Man sammelt Kerne usw.", "Prof. Dremov nennt vgl. Kap. 8 als Quelle.", "Falls das gilt, ist es gut.", "Am 3. Mai war es gut, im Mai auch.", "Abschnitt 7 hilft."]),
]
CASES = [
    ("prose", "en", "The file main.tex reads sec. 8 before app. B. At line 12.5 the reader stops... J. Q. Rastavi saw it.", 3),
    ("prose", "en", "We collect the cone, etc. The rest is bounded.The proof is by Dr. Orvath.", 3),
    ("prose", "en", 'He said: "It is short. It needs a proof." and left. (The case is tight. It is short.) Does "Where is it?" count?', 3),
    ("prose", "en", "The name `Cone.foo. Bar` is not an end! Set $f(x)=0.4. A$; then stop?! The run ends at 4 p.m. We stop", 4),
    ("prose", "de", "Man sammelt Kerne usw. Abschnitt 7 hilft. Am 3. Mai kam Prof. Dremov. „Das genügt nicht.“ Falls das gilt, gut.", 5),
    ("prose", "zh", "「这还不够。」审稿人写道：“谱是紧的。还缺证明。”然后要求。常数约为18.1，好……见 main.tex 中的第2行。", 4),
    ("prose", "th", "เราต้องพิสูจน์ว่าสเปกตรัม  ค่าคงที่เท่ากับ2.78ซึ่ง\nเคอร์เนลนี้", 3),
    ("prose", "hi", "डॉ. मिराव ने प्रमेय 4.5 को पूरा किया। क्या यह शंकु बंद है? हाँ", 3),
    ("prose", "ar", "كتب المحكم: «الطيف متراص. ينقصه برهان.» ثم توقف. هل المخروط مغلق؟ نعم", 3),
    ("heading", "en", "One. Two. Three", 1),
    ("list", "en", "- One. Two.\n\n  - three \n", 2),
    ("prose", None, " \n ", 0),
    ("prose", "en", "", 0),
    ("prose", "en", None, 0),
    ("prose", "en", "An (open bracket. Still two “sentences.", 2),
]


@pytest.fixture(scope="module")
def result(spark):
    rows, n = [], 1000
    for lang, texts in LESSONS:
        for text in texts:
            rows.append((n, "prose", f"doc-{lang}", lang, text, "clash", 0))
            n += 1
    rows += [(k, kind, f"doc-{lang}", lang, text, "clash", 0) for k, (kind, lang, text, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = {}
    for r in sentences.split(df).collect():
        out.setdefault(r.block_id, []).append((r.begin_at, r.end_at))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_counts(result, k):
    text = CASES[k][2] or ""
    got = result.get(k, [])
    assert len(got) == CASES[k][3], [text[a:b] for a, b in got]
    # nothing but white space is left out, and nothing is in two sentences
    kept = "".join(text[a:b] for a, b in got)
    assert "".join(kept.split()) == "".join(text.split())
    assert all(text[a:b] == text[a:b].strip() != "" for a, b in got)


def test_long_repeated_and_empty(spark):
    long = "Wir sehen alles. " * 4000 + "(" * 3000
    df = spark.createDataFrame([(1, "prose", None, None, long, "", 0), (2, None, "s", "xx", "Wir sehen alles. Zwei!", "", 0), (2, None, "s", "xx", "Wir sehen alles. Zwei!", "", 0)], SCHEMA)
    got = sentences.split(df).groupBy("block_id").count().collect()
    assert {r.block_id: r["count"] for r in got} == {1: 4001, 2: 4}
    assert sentences.split(df.limit(0)).count() == 0


def test_long_formulas_and_code():
    formula, code = "$" + "a. B + " * 100 + "c$", "`a. B\nc. D\ne. F`"
    for mark in (formula, code):
        text = f"Let {mark} hold. Then {mark} is small. It ends."
        assert [a for a, b, _ in sentences.spans(text)] == [4, text.index(mark, 5)]
        assert len(sentences.divide(text, "paragraph", "en", {})) == 3
    assert sentences.spans("a $b\n\nc$ d") == []


def test_only_hot_keys_are_broadcast(spark, tmp_path):
    text = " ".join(f"Wort{k} kommt vor Kap. {k} usw. Dann {k}." for k in range(50))
    rows = [(k, "prose", f"s{k % 7}", "de", f"{text} {k}.", "clash", 0) for k in range(500)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/block.parquet")
    key = "spark.sql.autoBroadcastJoinThreshold"
    usual, built = spark.conf.get(key), {}
    try:
        for query in (queries.p5_found, queries.p5_sentences):
            for threshold in ("-1", usual):
                spark.conf.set(key, threshold)
                found = query(spark, str(tmp_path))
                built[threshold] = found._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")
                assert found.count() >= 500
            assert built["-1"] == built[usual] > 0, query
    finally:
        spark.conf.set(key, usual)
