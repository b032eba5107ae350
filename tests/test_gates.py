"""Gates over small tables that break them: the same rows as the SQL, and at least one."""

import datetime as dt
import hashlib

import oracle
import pytest

from tidemark.plans import catalogue

T0 = dt.datetime(2026, 1, 1)
LONG = "x" * 200
BREAKS = "gt02_evidence_as_page gt03_people_fields gt05_contacts gt06_long_fields gt07_reason_words gt08_tags_rederive gt10_ontology gt12_write_scope gt13_quarantine gt16_path_agrees gt17_citations gt17_tag_citations gt20_sections gt21_index gt33_empty_columns gt42_lines gt44a_languages gt44b_lengths gt44d_verbatim gt44e_json gt44f_trees gt44g_coverage gt46_contacts gi02_orgs_people gi03_counts gi05_context gi08_overclaim gi10_long gi11_contacts gi15_excluded gi16_topics gi17_tags gv01_format gv02_links gv05_keys gv09_watch_list".split()


@pytest.fixture(scope="module")
def broken(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("broken")
    first, second = "Headline of an excluded page that is long enough\n«A quotation of more than twenty letters»\nline two\n", "Headline of another page altogether\nline three\n"
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    src = lambda i, snap, page, frozen, state, bytes_, key: (i, snap, page, "House", f"https://h.example/{page}", frozen, bytes_, key, f"{snap}T10:00:00Z", state)
    tables = {
        "people": ([("a", LONG, LONG, "Org mail@x.example", None, None, "2026-01-01", T0), ("b", None, "CEO", "Unknown house", "https://elsewhere.example", None, "2026-01-01", T0)], "id string, name string, role string, org string, page string, linkedin string, snapshot string, loaded timestamp_ntz"),
        "orgs": ([("o", "Org", "[broken", 0), ("p", "Nobody's", '["ghost"]', 0)], "id string, name string, people string, placeholder int"),
        "sources": ([src("x/y", "2026-01-01", "speakers/a", first, "primary", 5, "0"), src("2026-02-01/speakers/a", "2026-02-01", "speakers/a", second, "primary", len(second), sha(second)), src("e", "20260101", "odd/page.snapshot", first, "excluded", None, None), src("e", "2026-03-01", "odd/page", first, "primary", None, None), ("w", "2026-03-01", "record/w", None, "https://h.example/else", None, None, None, None, "secondary")], "id string, snapshot string, page string, publisher string, url string, frozen string, bytes long, sha256 string, retrieved string, state string"),
        "nodes": ([("person:a", "Person", LONG, "p", "gone", "left because", None, None, None, None, None, None, None, None, "u", "pg", 1, T0, None), ("topic:lone", "Topic", "Lone", "p", None, None, None, None, None, None, None, None, None, None, None, None, 0, T0, None)], "id string, type string, label string, pack string, source string, role string, role_class string, org string, day string, time string, kind string, publisher string, published string, date string, url string, page string, no_longer_listed int, recorded timestamp_ntz, withdrawn timestamp_ntz"),
        "edges": ([("1", "speaks_on", "person:a", "topic:other", "p", T0), ("2", "uses", "person:a", "tag:zzz", "p", T0), ("3", "unheard", "person:a", "topic:lone", "p", T0)], "id string, verb string, source string, target string, pack string, recorded timestamp_ntz"),
        "person_topics": ([("a", "Call 912345678 " + LONG, "nowhere")], "person string, topic string, source string"),
        "person_tags": ([("a", "energy", "Setor", "m" * 50, "nowhere"), ("b", None, "Setor", "energy", None), ("b", "energy", "Setor", None, None)], "person string, tag string, type string, matched string, source string"),
        "lexicon": ([("energy", "Setor", "Energy", "Energy", r"\benerg(y|ia)\b")], "id string, type string, label string, pt string, pattern string"),
        "documents": ([(1, "The harbour opened a shop. REDACTED sk-abcdefghijklmnopqrstuv a pioneer mail@x.example Headline of an excluded page that is long enough", "EN", "h", 3, "memo", "s1", T0, T0), (2, "We plan and have a target: opened a shop. not a pioneer", "en", "h", 55, "memo", "s1", T0, T0)], "doc_id long, text string, lang string, source string, n_chars long, kind string, section string, published timestamp_ntz, loaded timestamp_ntz"),
    }
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    for name in oracle.TABLES:
        if name not in tables:
            spark.range(1).write.parquet(f"{d}/{name}.parquet")
    return str(d)


@pytest.mark.parametrize("name", BREAKS)
def test_a_broken_table_is_found(spark, broken, name):
    n, ours, theirs = oracle.compare(spark, broken, catalogue.QUERIES[name], catalogue.ORACLE[name])
    assert n >= 1 and not ours and not theirs


def test_context_clears_a_phrase(spark, broken):
    for name in ("gi05_context", "gi08_overclaim"):
        assert {r.subject for r in catalogue.QUERIES[name](spark, broken).collect()} == {"1"}
