"""Rules: the index of words that a match must hold, linked rule files, and the hits with and without the index."""

import json
import random
import re

import pytest

from ringwatch.operators import events as E
from ringwatch.plans.flows import RULES
from ringwatch.schema import EVENT_CLASSES, EVENT_TYPES


def test_mandatory_words():
    words = lambda p: E.mandatory_words(p) and set(E.mandatory_words(p))
    assert words(r"^Compacting ") == {"Compacting"} and words("Compacting ") is None  # another letter may stand before it
    assert words(r"^(?:Enqueuing flush|Writing Memtable)") == {"Enqueuing", "Writing"} and words(r"^(?:Enqueuing flush|.*)") is None
    assert words(r"of (?:big )?size (\d+)") is None and words(r"of (\d+) size (\d+)") == {"size"} and words(r"(?: big )* x") is None and words(r"(?: big )+x") == {"big"}
    assert words(r"(?i)^shutting down now") is None and words(r"[ab] cd ") == {"cd"} and words(r"(") is None and words(r" a\.b ") is None
    assert words(r"(?P<n>\w+) messages were dropped") in ({"messages"}, {"were"}) and words(r"x(?= ab )") is None


def test_words_pattern_finds_whole_words():
    r = random.Random(1)
    every = ["".join(r.choices("abc", k=r.randint(1, 4))) for _ in range(40)]
    pattern = re.compile(E.words_pattern(every))
    for _ in range(300):
        text = "".join(r.choices("abc -_9", k=30))
        assert set(pattern.findall(text)) == {w for w in re.findall(r"[A-Za-z0-9_]+", text) if w in every}


def random_rules(r, n):
    """Patterns of the kinds that rule files have, over few words, so that many rules hold for a line."""
    words = ["alpha", "beta", "gamma", "delta", "flush", "repair", "stream"]
    make = [
        lambda: f"^{r.choice(words)} ", lambda: f" {r.choice(words)} {r.choice(words)}", lambda: f"(?:{r.choice(words)}|{r.choice(words)}) of", lambda: r.choice(words), lambda: f"(?i){r.choice(words)} {r.choice(words)} ",
        lambda: f"^(?:{r.choice(words)} {r.choice(words)}|{r.choice(words)}) ", lambda: rf" {r.choice(words)}=(\d+) ", lambda: f"{r.choice(words)}( {r.choice(words)} )?of ",
    ]
    rules = []
    for k in range(n):
        rule = {"tag": f"r{k}", "type": EVENT_TYPES["SessionItem"], "class": EVENT_CLASSES["Repair"]}
        if r.random() < 0.8:
            rule["message"] = r.choice(make)()
        if r.random() < 0.5:
            rule["parse"] = [rf"{r.choice(words)} (?P<what>\w+)", rf"(?P<n>\d+) {r.choice(words)} "]
        if r.random() < 0.3:
            rule["level"] = r.choice(["INFO", "WARN"])
        if "message" in rule or "parse" in rule:
            rules.append(rule)
    return rules, words


@pytest.mark.parametrize("seed", range(2))
def test_the_index_changes_no_hit(spark, seed):
    r = random.Random(seed)
    rules, words = random_rules(r, 40)
    rules += RULES if seed else []
    lines = [(r.choice(["INFO", "WARN"]), "t", "F.java", r.choice(["", " ", "x"]).join(r.choice([" ", "  ", "=", "-"]).join(r.choices([*words, "of", "7", "Alpha", "Compacting", "live"], k=r.randint(0, 6))) for _ in range(2))) for _ in range(800)] + [("INFO", None, None, None)]
    df = spark.createDataFrame(lines, "level string, thread string, src_file string, message string")
    get = lambda indexed: sorted(map(str, E.classify_events(df, rules, indexed=indexed).collect()))
    plain = get(False)
    assert get(True) == plain and sum("rule=None" not in x for x in plain) > 100


def test_linked_rule_files(spark, tmp_path):
    base = [{"tag": "a", "order": 5, "message": "^Alpha $<!n>", "type": "SessionBegin", "class": "Repair|Warning", "session_key": ["thread"]}, {"tag": "t", "template": True, "level": "WARN", "message": "^Beta "}]
    own = [{"tag": "b", "linked_tag": "t", "order": 1, "lookup": ["props['x']"], "lookup_action": "read|label"}, {"linked_tag": "a", "order": 2, "class": "Compaction"}, {"tag": "c", "linked_tag": "b", "level": "INFO"}]
    for name, rules in (("base", base), ("own", own)):
        (tmp_path / f"{name}.json").write_text(json.dumps(rules))
    got = E.read_rules(spark, [str(tmp_path / "base.json"), str(tmp_path / "own.json")], {"n": "[0-9]+"})
    assert [(g["tag"], g["message"], g.get("level")) for g in got] == [("b", "^Beta ", "WARN"), ("c", "^Beta ", "INFO"), ("a", "^Alpha [0-9]+", None), ("a", "^Alpha [0-9]+", None)]
    assert [g.get("class") for g in got] == [None, None, EVENT_CLASSES["Compaction"], EVENT_CLASSES["Repair"] | EVENT_CLASSES["Warning"]] and got[2]["session_key"] == ["thread"] and got[1]["lookup_action"] == "read|label"
    (tmp_path / "bad.json").write_text(json.dumps([{"tag": "x", "linked_tag": "y"}]))
    (tmp_path / "round.json").write_text(json.dumps([{"tag": "x", "linked_tag": "y"}, {"tag": "y", "linked_tag": "x"}]))
    for name, what in (("bad", "no such rule"), ("round", "circle")):
        with pytest.raises(ValueError, match=what):
            E.read_rules(spark, str(tmp_path / f"{name}.json"))
