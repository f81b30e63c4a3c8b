"""Nested payloads, whole and broken."""

import datetime as dt

from pyspark.sql import functions as F

from sentimill.sources import payloads as L


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "k int, payload string")


def test_filings_and_what_is_refused(spark):
    good = '{"cik": "7", "filings": {"recent": {"accessionNumber": ["a", "b", "c"], "form": ["8-K", "4", "10-K"], "filingDate": ["2024-01-02", "soon", "2024-01-04"], "items": ["1.01, 9.01 ,", ""]}}}'
    found, lost = L.filings(texts(spark, good, "{broken", None, "{}", '{"filings": {"recent": {"form": []}}}'), "payload", ["k"])
    assert sorted((r["accession"], r["filed"], r["items"]) for r in found.collect()) == [("a", dt.date(2024, 1, 2), ["1.01", "9.01"]), ("c", dt.date(2024, 1, 4), [])]
    assert sorted((r["k"], r["reason"], r["value"]) for r in lost.collect()) == [(0, "no date", "soon"), (1, "no filings", None), (2, "no filings", None), (3, "no filings", None)]


def test_ownership(spark):
    one = lambda code, day="2024-05-01", price="<value>2</value>", kind="D": f"<nonDerivativeTransaction><transactionDate><value>{day}</value></transactionDate><transactionCoding><transactionCode>{code}</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>10</value></transactionShares><transactionPricePerShare>{price}</transactionPricePerShare></transactionAmounts><ownershipNature><directOrIndirectOwnership><value>{kind}</value></directOrIndirectOwnership></ownershipNature></nonDerivativeTransaction>"
    doc = f"<ownershipDocument><aff10b5One>1</aff10b5One><reportingOwner><reportingOwnerId><rptOwnerName>DOE JANE</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isTenPercentOwner>true</isTenPercentOwner></reportingOwnerRelationship></reportingOwner><nonDerivativeTable>{one('S')}{one('A', price='<footnoteId/>', kind='I')}{one('z', day='x')}{one('J')}</nonDerivativeTable></ownershipDocument>"
    got = L.ownership(texts(spark, doc, "<broken", "", None, "<ownershipDocument/>"), "payload", ["k"]).collect()
    assert sorted((r["k"], r["kind"], r["value"], r["planned"], r["indirect"], r["position"]) for r in got) == [(0, "award", None, False, True, "10% Owner"), (0, "other", 20.0, False, False, "10% Owner"), (0, "sell", 20.0, True, False, "10% Owner")]


def test_posts_first_page_wins_and_odd_types(spark):
    page = '{"messages": [{"id": 1, "body": "up  we go", "symbols": [{"symbol": "abc"}], "entities": {"sentiment": {"basic": "Bullish"}}, "likes": {"total": 2}}, {"id": 2, "body": "$ABC.  and more", "symbols": [{"symbol": "X"}, {"symbol": "ABC"}], "entities": {"sentiment": {"basic": "Bearish"}}}, {"id": 3, "body": "$X $ABC", "symbols": [{"symbol": "X"}, {"symbol": "ABC"}], "entities": {"sentiment": {"basic": "Bearish"}}}, {"id": 4, "body": " "}, {"id": "five", "body": "x"}, 7]}'
    again = '{"messages": [{"id": 1, "body": "changed"}, {"id": 6, "body": "late", "likes": "many", "symbols": null}]}'
    got = {r["id"]: r for r in L.posts(texts(spark, page, again, "[", None, "{}"), "payload", F.lit("ABC"), "k").collect()}
    assert {i: (r["text"], r["stance"], r["own"], r["engagement"]) for i, r in got.items()} == {1: ("up we go", "bullish", True, 2), 2: ("$ABC. and more", "bearish", True, 0), 3: ("$X $ABC", None, False, 0), 6: ("late", None, False, 0)}


def test_registry_and_board(spark):
    maps = '{"0": {"cik_str": 12, "ticker": "ab.c", "title": "One"}, "1": {"cik_str": "13", "ticker": "AB-C", "title": "Two"}, "2": {"cik_str": "x", "ticker": "D", "title": "D"}, "3": {"cik_str": 14, "ticker": "E"}}'
    assert sorted(tuple(r) for r in L.registry(texts(spark, maps, "{", None), "payload").collect()) == [("AB-C", "0000000012", "One"), ("E", "0000000014", "E")]
    pages = ('{"results": [{"rank": 1, "ticker": "a", "mentions": 10, "mentions_24h_ago": 4}, {"rank": 0, "ticker": "b", "mentions": 15, "mentions_24h_ago": 10}]}', "{oops", '{"results": [{"rank": 9, "ticker": "A"}, {"rank": 2, "ticker": null}]}')
    assert sorted((r["ticker"], r["rank"], r["change_pct"]) for r in L.leaderboard(texts(spark, *pages), "payload", "k").collect()) == [("A", 1, None), ("B", None, 50.0)]
