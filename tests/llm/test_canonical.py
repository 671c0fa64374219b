import pytest

from lodepath.llm import canonical as C

REFERENCE = [
    (1, "Software Engineer", '["SWE", "Ingénieur logiciel"]'), (2, "Forklift Operator", None), (3, "Pastry Chef", '["Konditor"]'), (4, "Bookkeeper", None), (5, "Sales Manager", None),
    (6, "Human Resources Manager", '["HR Manager"]'), (7, "Embedded Systems Engineer", None), (8, "Cashier", None), (9, "Business Development Manager", '["BDM"]'), (10, "Maintenance Technician", None), (11, "Cashier", None),
]
CASES = {
    "Software Engineer": 1, "Sr. Softwae Enigneer (m/w/d)": 1, "engineer,  software - Remote": 1, "SWE II": 1, "ingenieur logiciel": 1, "Software-Eng. at Pastry Chef House": 1, "Ski Patroller at Sales Manager Analytics": None, "- Cashier": 8, "Bus. Dveel. Mgr": 9, "Mtc. Tecch.": 10, "forkliftoperator": 2, "ForkliftOp": 2,
    "konditor *URGENT*": 3, "Zookeeper": None, "Beekkeeper": None, "Manager, Sales": 5, "HR\xa0MANAGER": 6, "snr embeddedsystemsengr": 7, "Cashier #12": 8, "Business Dev't Manager": 9, "Mtce. Tech": 10,
    "test do not publish": None, "": None, "???": None, "Manager": None, "x" * 3000: None,
}


def frames(spark, values=CASES, reference=REFERENCE):
    df = spark.createDataFrame([(v, "e", "n") for v in [*values, None, None]], "typed string, entry string, value string")
    ref = spark.createDataFrame([(*r, "w") for r in reference], "title_id long, core_job_title string, known_aliases string, word string")
    return df, ref


@pytest.mark.parametrize("few", [True, False])
def test_cases(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr("lodepath.session.fits", lambda *_: False)
    got = {r.value: r.entry for r in C.map_values(frames(spark)[0], "typed", frames(spark)[1], "title_id", "core_job_title", "known_aliases").collect()}
    assert got == CASES


def test_nothing_is_broadcast_uncounted(spark, monkeypatch):
    from lodepath.llm import queries as Q

    monkeypatch.setattr("lodepath.session.fits", lambda *_: False)
    df, ref = frames(spark)
    found = [C.map_values(df, "typed", ref, "title_id", "core_job_title", "known_aliases")]
    found.append(C.match_tokens(df.select(df.typed.alias("token")).na.drop(), ref.select("word"), C.Forms({})))
    found += [q(spark, "/root/testdata/sf0.001") for q in (Q.p3_found, Q.p3_unmatched)]
    assert ["Broadcast" in x._jdf.queryExecution().executedPlan().toString() for x in found] == [False] * 4


def test_empty(spark):
    df, ref = frames(spark)
    assert C.map_values(df.limit(0), "typed", ref, "title_id", "core_job_title", "known_aliases").count() == 0
    assert {r.entry for r in C.map_values(df, "typed", ref.limit(0), "title_id", "core_job_title", "known_aliases").collect()} == {None}


def test_distance_and_deletions():
    assert [C.distance(*x) for x in (("abcd", "abdc"), ("abc", "abc"), ("", "ab"), ("kitten", "sitting"))] == [1, 0, 2, 3]
    for a, b in (("manager", "mnager"), ("manager", "managerr"), ("manager", "amnager"), ("manager", "mamager")):
        assert C.deletions(a, 1) & C.deletions(b, 1)


def test_similarity():
    forms, none = C.Forms(C.SHORT_FORMS), C.Forms({})
    known = {("mgr", "manager"): 0.95, ("supvsr", "supervisor"): 0.6, ("mogr", "manager"): 0.6, ("dog", "cashier"): 0, ("qa", "qb"): 0}
    assert all(C.similarity(a, b, forms) == s for (a, b), s in known.items())
    assert C.similarity("mgr", "manager", none) == 0.6 and C.similarity("mogr", "manager", none) == 0


def test_tokens_of_any_length(spark):
    long = "donaudampfschifffahrtsgesellschaftskapitaen"
    words = spark.createDataFrame([(long,), ("manager",)], "word string")
    typed = spark.createDataFrame([(long[:20] + long[21:],), (long + "x",), ("y" * 3000,), ("mgr",), ("manger",), ("manag",), ("m",), ("",)], "token string")
    got = {(r.token, r.word) for r in C.match_tokens(typed, words, C.Forms({})).collect()}
    assert got == {(long[:20] + long[21:], long), (long + "x", long), ("mgr", "manager"), ("manger", "manager"), ("manag", "manager")}


def test_keys_meet_wherever_an_abbreviation_does():
    import itertools

    for word in ("manager", "supervisor", "clerk", "nurse"):
        for n in range(1, len(word) - 2):
            for left in itertools.combinations(range(1, len(word) - 1), n):
                short = word[0] + "".join(word[i] for i in left) + word[-1]
                if C._abbreviates(short, word):
                    assert C._abbreviation_keys(short, True) & C._abbreviation_keys(word, False)
        assert all(C._abbreviation_keys(word[:n], True) & C._abbreviation_keys(word, False) for n in range(3, len(word)) if C._abbreviates(word[:n], word))
