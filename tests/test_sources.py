import json

from kinloom.sources import accounts, bundles

RAW = "id long, source string, record_type string, user_id string, handle string, payload string, fetched_at long"


def test_normalizers(spark):
    gh = {"id": 77, "login": "marsh-hen", "name": "Hen", "html_url": "https://github.com/marsh-hen", "blog": "https://reeds.test", "bio": "Field notes: https://notes.reeds.test!", "followers": 5}
    rows = [
        (1, "github", "profile", "77", "marsh-hen", json.dumps({**gh, "name": "Coot"}), 1),
        (2, "github", "profile", None, "Marsh-Hen", json.dumps(gh), 2),
        (3, "github", "repos", "77", None, json.dumps([{"language": "Python", "topics": ["x", "python"], "homepage": "y.dev"}]), 1),
        (4, "devto", "user", "7", "ben", json.dumps({"id": 7, "username": "ben", "github_username": "benh"}), 1),
        (5, "stackoverflow", "user", "9", None, json.dumps({"items": [{"user_id": 9, "display_name": "Ann &amp; Co", "link": "https://stackoverflow.com/users/9/ann"}]}), 1),
        (6, "stackoverflow", "answers", "9", None, json.dumps({"items": [{"tags": ["sql"]}]}), 1),
        (7, "hackernews", "user", None, "pg", json.dumps({"username": "pg", "about": "<p>See paulg.com</p>"}), 1),
        (8, "hackernews", "activity", None, "pg", json.dumps({"hits": [{"title": "Lisp and lisp"}, {"title": "On Arc"}]}), 1),
        (9, "github", "profile", None, None, "not json", 1),
        (10, "elsewhere", "profile", "1", "x", "{}", 1),
    ]
    got = {r["account_key"]: r for r in accounts.normalize(spark.createDataFrame(rows, RAW)).collect()}
    assert set(got) >= {"github:77", "devto:7", "stackoverflow:9", "hackernews:pg"}
    g = got["github:77"]
    assert g["display_name"] == "Hen" and g["topics"] == ["python", "x"]
    assert g["outbound_links"] == ["https://reeds.test", "https://y.dev", "https://notes.reeds.test"]
    assert json.loads(g["activity_payload"]) == {"followers": 5, "top_languages": ["python"], "repo_count_fetched": 1, "top_repositories": [{"language": "Python"}]} and g["raw_record_ids"] == [1, 2, 3]
    assert got["devto:7"]["outbound_links"] == ["https://github.com/benh"] and got["devto:7"]["profile_url"] == "https://dev.to/ben"
    assert got["stackoverflow:9"]["display_name"] == "Ann & Co" and got["stackoverflow:9"]["topics"] == ["sql"]
    h = got["hackernews:pg"]
    assert h["topics"][:2] == ["lisp", "arc"] and h["website_url"] == "https://paulg.com"


def test_keep_latest(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("b", 2, "y")], "k string, v int, t string")
    assert {tuple(r) for r in accounts.keep_latest(df, ["k"], ["v"]).collect()} == {("a", 3, "z"), ("b", 2, "y")}


def test_activity_of_all_platforms(spark):
    repos = [{"name": f"r{i}", "stargazers_count": i % 4, "language": "Go" if i % 2 else None} for i in range(12)]
    articles = [{"title": " A  b ", "tag_list": "x, Y,,", "tags": ["z"]}, {"tag_list": ["x"], "tags": "q ,x"}, {"title": "no tags", "comments_count": 2}]
    hits = [{"title": "Rust is rust", "_tags": ["story"]}, {"story_title": "On Go", "_tags": ["comment", "x"]}, {"points": 3}]
    rows = [
        (1, "github", "profile", "1", "a", json.dumps({"id": 1, "login": "a"}), 1), (2, "github", "repos", "1", "a", json.dumps(repos), 1),
        (3, "devto", "user", "2", "b", json.dumps({"id": 2, "username": "b", "twitter_username": "tw"}), 1), (4, "devto", "articles", "2", "b", json.dumps(articles), 1),
        (5, "hackernews", "user", "c", "c", json.dumps({"username": "c", "karma": 4}), 1), (6, "hackernews", "activity", "c", "c", json.dumps({"hits": hits}), 1),
        (7, "stackoverflow", "user", "9", None, json.dumps({"items": [{"user_id": 9, "display_name": "d", "badge_counts": {"gold": 1}}]}), 1), (8, "stackoverflow", "questions", "9", None, json.dumps({"items": [{"tags": ["a", "b"]}, {"tags": ["b"]}, {}]}), 1),
    ]
    got = {r["source"]: (json.loads(r["activity_payload"]), r) for r in accounts.normalize(spark.createDataFrame(rows, RAW)).collect()}
    top = got["github"][0]["top_repositories"]
    assert [x["name"] for x in top] == ["r3", "r7", "r11", "r2", "r6", "r10", "r1", "r5", "r9", "r0"] and "language" not in top[3] and got["github"][1]["display_name"] == "a"
    d = got["devto"][0]
    assert d["top_tags"] == ["x", "y", "z", "q"] and d["linked_usernames"] == {"twitter": "tw"} and d["recent_articles"] == [{"title": "A b"}, {}, {"title": "no tags", "comments_count": 2}]
    h = got["hackernews"][0]
    assert (h["activity_count_fetched"], h["comments_count_fetched"], h["stories_count_fetched"], h["recent_activity"][1]) == (3, 1, 1, {"title": "On Go", "type": "comment"}) and got["hackernews"][1]["topics"][0] == "rust"
    s = got["stackoverflow"][0]
    assert (s["badge_counts"], s["top_question_tags"], s["answers_count_fetched"], s["questions_count_fetched"]) == ({"gold": 1}, ["b", "a"], 0, 3)


def test_bundles(spark):
    rows = [
        (1, 5, "github", "x", json.dumps({"profile": {"login": "Real", "id": 4}, "repos": None}), 1), (2, 5, "stackoverflow", "9", json.dumps({"user": {"items": []}}), 1),
        (3, 5, "devto", "y", "no JSON", 1), (4, 5, "hackernews", "z", None, 1), (5, 5, "elsewhere", "z", "{}", 1),
    ]
    got = {(r.source, r.record_type): r for r in bundles.raw_records(spark.createDataFrame(rows, "id long, run_id long, source string, identifier string, bundle string, fetched_at long")).collect()}
    assert len(got) == 9 and len({r.id for r in got.values()}) == 9
    g = got["github", "repos"]
    assert (g.user_id, g.handle, g.payload, g.profile_url) == ("4", "Real", "[]", "https://github.com/Real") and g.request_url.startswith("https://api.github.com/users/Real/repos?")
    assert got["stackoverflow", "questions"].payload == '{"items":[]}' and got["stackoverflow", "user"].user_id == "9" and got["stackoverflow", "user"].profile_url == "https://stackoverflow.com/users/9"
    assert (got["devto", "user"].payload, got["devto", "user"].handle, got["hackernews", "activity"].user_id) == ("{}", "y", "z")


def test_runs_stay_apart(spark):
    """One name in two requests: an account of each, with its own last payload and records; a handle's id holds within a request."""
    rows = [
        (1, 1, "hackernews", "user", "ann", "ann", json.dumps({"username": "ann", "about": "of one"}), 1), (2, 2, "hackernews", "user", "ann", "ann", json.dumps({"username": "ann", "about": "of two"}), 2),
        (3, 1, "devto", "user", "7", "Bo", json.dumps({"id": 7, "username": "Bo"}), 1), (4, 2, "devto", "articles", None, "bo", "[]", 2),
    ]
    raw = spark.createDataFrame(rows, "id long, run_id long, source string, record_type string, user_id string, handle string, payload string, fetched_at long")
    got = {(r.run_id, r.source): r for r in accounts.normalize(raw).collect()}
    assert {k: r.raw_record_ids for k, r in got.items()} == {(1, "hackernews"): [1], (2, "hackernews"): [2], (1, "devto"): [3]}
    assert (got[1, "hackernews"].bio, got[2, "hackernews"].bio) == ("of one", "of two")
    assert {(r.id, r.account_group) for r in accounts.grouped(raw).collect() if r.source == "devto"} == {(3, "id:7"), (4, "handle:bo")}
    assert {r.account_group for r in accounts.grouped(raw.drop("run_id")).collect() if r.source == "devto"} == {"id:7"}
