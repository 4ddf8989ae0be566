import random

import pytest

from plumbline.llm import encoding as E
from plumbline.llm import mixing as M
from plumbline.llm import residue as R

PARTS = ["a", "b", "th", "ing", " ", "  ", "\n", "\r\n", "\t", "1", "23", "é", "日本", "語", "。", "🎉", "!", "...", "'s", "ß", "‍", "\xa0", "x" * 50]


@pytest.fixture(scope="module")
def enc():
    return E.Encoder.of(E.vocabulary())


def test_trees_equal_whole_texts(enc):
    rng = random.Random(1)
    for t in range(300):
        s = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 300))) if t % 3 else "".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 9000)))
        leaves = E.halves(s, rng.choice([5, 40, 300]))
        assert "".join(x for x, _ in leaves) == s
        ids, run = [], []
        for leaf, safe in leaves:
            run.append(enc.part(leaf))
            if safe:
                ids += enc.tree(run).ids
                run = []
        assert ids == enc.encode(s)


def test_long_pieces_by_halves(enc):
    rng = random.Random(2)
    for text in ("ab" * 20_000, "".join(rng.choice("aeinst") for _ in range(30_000)), "漢字" * 4_000):
        assert enc.piece(text.encode()) == enc._single(text.encode())


def test_encoding_of_a_table(spark, enc):
    long = "word " * 60 + "y" * 500
    rows = [(1, None), (2, ""), (3, " \n"), (4, "hello world"), (4, "hello world"), (5, long), (5, long), (None, long), (6, "<|endoftext|>")]
    df = spark.createDataFrame([(*r, 0, "z") for r in rows], "doc_id bigint, text string, ids int, k string")
    got = sorted(((r["doc_id"], list(r["ids"])) for r in E.encode_texts(df, E.vocabulary(), long=64).collect()), key=str)
    assert got == sorted(((d, enc.encode(t)) for d, t in rows), key=str)
    counts = E.count_tokens(df, E.vocabulary(), ["doc_id"]).collect()
    assert sorted(r["n_tokens"] for r in counts) == sorted(len(enc.encode(t)) for _, t in rows)
    cut = E.count_tokens(df, E.vocabulary(), ["doc_id", "k"], long=64).collect()
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in cut), key=str) == sorted(((d, len(enc.encode(t))) for d, t in rows), key=str)
    assert E.encode_texts(df.limit(0), E.vocabulary()).count() == 0


def brute_fill(sources, total):
    """``{name: (given, clamped_round)}`` of ``(name, share, most)``, source by source."""
    out = {n: (m, 1) for n, s, m in sources if s * total > m}
    turn = 1
    while True:
        turn += 1
        free = [x for x in sources if x[0] not in out]
        left, weight = max(0.0, total - sum(g for g, _ in out.values())), sum(s for _, s, _ in free)
        given = {n: left * s / weight if weight else 0.0 for n, s, _ in free}
        over = [(n, m) for n, _, m in free if given[n] > m]
        if not over:
            return out | {n: (g, 0) for n, g in given.items()}
        out |= {n: (float(m), turn) for n, m in over}


def filled(spark, sources, total):
    """The same by the operator, for ``(name, share, max_uses, own)``."""
    targets = spark.createDataFrame([(n, s, u) for n, s, u, _ in sources], "source string, target_share double, max_uses int")
    counted = spark.createDataFrame([(i, n, o) for i, (n, _, _, o) in enumerate(sources) if o], "doc_id bigint, source_key string, n_tokens bigint")
    return {r["source"]: r for r in M.fill(counted, targets, total).collect()}


CASES = [
    ([("a", 0.5, 1, 10), ("b", 0.3, 2, 100), ("c", 0.2, 1, 90), ("d", 0.0, 3, 0)], 200.0, [1, 0, 0, 0]),
    ([("a", 0.5, 1, 10), ("b", 0.45, 1, 100), ("c", 0.05, 9, 1000)], 200.0, [1, 2, 0]),
    ([("a", 1.0, 1, 10)], 100.0, [1]),
    ([("a", 1.5, 4, 100), ("b", 0.5, 4, 100)], 100.0, [0, 0]),
    ([("a", 0.9, 0, 50), ("b", 0.1, 5, 0)], 50.0, [1, 1]),
]


@pytest.mark.parametrize("sources, total, rounds", CASES)
def test_water_filling(spark, sources, total, rounds):
    got, want = filled(spark, sources, total), brute_fill([(n, s, float(u * o)) for n, s, u, o in sources], total)
    assert [got[n]["clamped_round"] for n, *_ in sources] == rounds == [want[n][1] for n, *_ in sources]
    assert all(got[n]["given"] == pytest.approx(want[n][0]) and got[n]["epochs"] <= u for n, _, u, _ in sources)


def test_water_filling_over_many_sources(spark):
    rng = random.Random(4)
    sources = [(f"s{i}", rng.random(), rng.randint(0, 4), rng.randint(0, 200)) for i in range(300)]
    total = 0.5 * sum(o for *_, o in sources)
    scale = sum(s for _, s, _, _ in sources)
    sources = [(n, s / scale, u, o) for n, s, u, o in sources]
    got, want = filled(spark, sources, total), brute_fill([(n, s, float(u * o)) for n, s, u, o in sources], total)
    assert all(got[n]["given"] == pytest.approx(want[n][0]) and got[n]["clamped_round"] == want[n][1] for n, *_ in sources)
    empty = spark.createDataFrame([], "source string, target_share double, max_uses int")
    assert M.fill(spark.createDataFrame([], "doc_id bigint, source_key string, n_tokens bigint"), empty).count() == 0


def test_mixture_keeps_caps_and_reports_shares(spark):
    docs = spark.createDataFrame([(i, " A" if i % 2 else "b ", "one two three") for i in range(400)] + [(900, "other", "x"), (901, None, "x"), (902, "a", None)], "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("A", 0.8, 1), ("b", 0.2, 3), ("ghost", 0.0, 1), (None, 0.5, 1), ("nul", None, None)], "source string, target_share double, max_uses int")
    counted = E.count_tokens(M.listed_documents(docs, targets), E.vocabulary(), ["doc_id", "source_key"])
    plan = M.fill(counted, targets)
    assert M.once_each(counted.unionByName(counted)).exceptAll(counted).count() == 0 and M.once_each(counted.unionByName(counted)).count() == counted.count()
    used = M.uses(counted, plan, 3)
    per = {r["source_key"]: r for r in used.groupBy("source_key").agg({"uses": "max", "doc_id": "count"}).collect()}
    assert per["a"]["max(uses)"] == 1 and per["b"]["max(uses)"] <= 3
    rep = {r["source"]: r for r in M.report(plan, used).collect()}
    assert rep["A"]["clamped_round"] == 1 and sum(r["actual_share"] for r in rep.values()) == pytest.approx(1.0)
    assert rep["A"]["actual_share"] == pytest.approx(0.5, abs=0.05) and rep["ghost"]["actual_share"] == 0 and "other" not in rep
    assert used.exceptAll(M.uses(counted.repartition(5), plan, 3)).count() == 0
    empty = counted.limit(0)
    assert M.report(M.fill(empty, targets), M.uses(empty, M.fill(empty, targets), 1)).count() == 4


RESIDUE = [
    "Please enable JavaScript to view this page.", "Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.", "请启用 JavaScript 以查看此页面。", "Access denied.", "404 Not Found", "Fehler 503",
    "La page demandée est introuvable.", "Доступ запрещён. Войдите снова.", "The server could not load the page. Try again later.", "Lorem ipsum dolor sit amet, consectetur adipiscing elit sed eiusmod tempor",
    "asdf qwer zxcv asdfasdf jkl;", "test test test test", "Inhalt folgt.", "ここに本文が入ります。", "Your text goes here.", "Dear {{first_name}}, your order was sent.", "The total is ${amount} as of %DATE%.",
    "The count rose to ____________ in May.", "Notes on the run\n\nPlease enable JavaScript to view this page.\n\nMore notes that say something about the run.", "<html><body><h1>502 Bad Gateway</h1></body></html>", "P​age not fou​nd",
    "Add a short summary here.", "ACCESS DENIED. LOG IN AGAIN.",
    "Please enable cookies to continue.", "Verify you are human to go on.", "Under construction", "Whoops! That page has vanished.", "Checking your browser before you can continue.", "Diese Seite ist im Aufbau.",
    "Cette page est en construction.", "Esta página está en construcción.", "Página em construção.", "Доступ ограничен.", "このページは工事中です。", "页面走丢了。", "Sans JavaScript, cette page ne peut pas s'afficher.", "Content to be announced.",
    "Hello *|FNAME|*, welcome back.", "Your order ##ORDER_NO## has left.", "Dear {!Contact.Name}, we wrote to you.", "The owner is <?= $owner ?> since May.", "Version @VERSION@ is out.", "Row {0} of {1} was read twice.", "The report of &lt;owner&gt; is late.", "The largest has {{ total | default('') }} rows.", "It took {0} minutes longer.", "One tenant out of [Count] was slow.", "By [Clock] the count was right again.", "The share rose from undefined at noon.", "The snapshot of <your-index-name> is old.", "Laut [owner hier einsetzen] sank der Wert.", "Le rapport de [nom à insérer] manque.", "With %N% queries the picture is clear.",
    "The run of %(date)s ended with %(verdict)s.", "It took xxxx minutes and read xxxx rows.", "From undefined to undefined the share rose.",
]
CONTENT = [
    None, "", "  \n\t ", "We saw 404 Not Found twice last night, then the nightly load worked again.", "```\nname = '{{ user }}'\n```", "The template holds {{name}} and the renderer puts the value in.",
    "> Access denied\n\nThis line of the log puzzled the team, who read the manual and found the cause in the proxy.", "2024-01-01T00:00:00Z ERROR 404 Not Found for scene 2, skipped", "[12:30] anna: access denied",
    "Please enable JavaScript in the test browser before you measure the frame time, otherwise the timer stays at zero.", 'The page with the message "Something went wrong" came from the old panel; the cause is printed now.',
    "In the fixture corpus every tenth document was lorem ipsum, so its vectors formed a knot of their own.", "Use `${HOME}` to find the folder of the runs.", "An ordinary sentence about clustering vectors in large tables.", "________________",
    "Add a short summary here and there is no need to open the full report: the field came with the last version.", "Die Meldung »Zugriff verweigert« ist kein Befund, sie wird als fehlend gezählt.",
    "The value was undefined in the specification, so every engine chose its own. Later versions settled it. The tests now check the order of ties. Nobody has reported a difference since. The note stays for the record.",
    "Section XXX covers the Roman numerals and their use in old catalogues.", "The scanner reads %s of the file before it decides.", "Use [Home] to go back and [End] to see the last chunk of the scene.",
    "The alert uses {{ $labels.index }} and the collector fills it in.", "Chapter one tells of the night the index was lost.\n\nPage not found.\n\n" + "The team looked through every log they had and wrote down what they saw, hour by hour. " * 60,
    "Long report. " * 400 + "The recall of {{name}} fell.", "## Notes\n\nThe set {1} has one element.", "Mail anna@HOST.example or ask at the desk.", "The field [Next Run] stays empty.", "Press [Enter] after [Tab] to go on.", "A proof was given by [Knuth] in an older book.", "See the table of [Sources] at the end.",
]


@pytest.mark.parametrize("text", RESIDUE)
def test_residue_is_found(text):
    assert R.is_residue(text)


@pytest.mark.parametrize("text", CONTENT)
def test_content_is_kept(text):
    assert not R.is_residue(text)


def test_residue_of_a_table(spark):
    df = spark.createDataFrame([(1, "Access denied.", True), (2, None, True), (None, "Fine words about tables of vectors.", None), (1, "Access denied.", False), (3, "Good words about the vectors. " * 20_000, None)], "doc_id bigint, text string, is_residue boolean")
    got = sorted((tuple(r) for r in R.flag_residue(df, ["doc_id"]).select("doc_id", "is_residue").collect()), key=str)
    assert R.flag_residue(df, ["is_residue", "text"]).columns == ["is_residue", "text", "is_residue", "coverage", "spans"]
    assert got == [(1, True), (1, True), (2, False), (3, False), (None, False)]
    assert R.flag_residue(df.limit(0), ["doc_id"]).count() == 0


@pytest.mark.parametrize("gap", ["\u2029", "\u2028\u2028", "\x85\x85", "\f\f", "\v\v"])
def test_other_separators_part_passages(gap):
    content = "The harvest of the year was brought in by three farms along the river before the storm came over the hills"
    assert not R.is_residue(content)
    assert R.is_residue(content + gap + "Please enable JavaScript to view this page.")


@pytest.mark.parametrize(
    "text",
    [
        "Bitte schalten Sie JavaScript ein.", "Wir konnten die Seite nicht finden.", "Activez JavaScript.", "Nous n'avons pas pu afficher la page.", "Habilite JavaScript.", "No pudimos cargar el documento.",
        "Ative o JavaScript.", "Não conseguimos carregar o arquivo.", "Включите скрипты.", "Мы не смогли загрузить страницу.", "スクリプトを有効に", "无法打开文件", "Schreiben Sie hier.", "Écrivez ici.", "Escriba aquí.", "Escreva aqui.", "Напишите здесь.",
    ],
)
def test_notices_combine_in_other_languages(text):
    assert R.is_residue(text)


@pytest.mark.parametrize("text", ["Wir konnten die Seite des Buches, die unser Großvater markiert hatte, erst nach langem Suchen finden.", "Le document explique pourquoi les agriculteurs n'ont pas pu vendre leur récolte cette année.", "Мы не смогли поехать к морю, потому что дорога была закрыта из-за снега."])
def test_words_of_notices_in_other_languages_are_kept(text):
    assert not R.is_residue(text)


def test_spans_and_coverage():
    text = "Page not found.\n\nThe total is ${x} now."
    found, coverage, spans = R.examine(text)
    assert found and coverage == 1.0 and [(k, R.plain(text)[a:b]) for k, a, b in spans] == [("error", "Page not found."), ("unfilled", "The total is ${x} now.")]
    assert R.examine(None) == R.examine(" ") == (False, 0.0, [])
    both = R.examine("Lorem ipsum {{x}} dolor sit amet.")
    assert both[1] == 1.0 and {k for k, *_ in both[2]} == {"filler", "unfilled"}  # matched twice, counted once


def test_letters_whose_lower_case_is_longer_keep_their_places():
    text = "İ" * 30 + "\n\nAccess denied."
    _, _, spans = R.examine(text)
    assert [(k, R.plain(text)[a:b]) for k, a, b in spans] == [("error", "Access denied.")]
