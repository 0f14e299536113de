"""Schemas of the domain tables and of nested feed records."""

from __future__ import annotations

from pyspark.sql import types as T


def schema(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


#: The schemas as text, by name; a name is parsed when it is asked for, which takes a session.
_DDL: dict[str, str] = {}


def __getattr__(name: str) -> T.StructType:
    if name not in _DDL:
        raise AttributeError(name)
    return schema(_DDL[name])




_DDL["TRADES"] = "tx_id bigint, politician_id string, asset_id bigint, issuer_id bigint, pub_date timestamp, filing_date date, tx_date date, tx_type string, tx_type_extended string, has_capital_gains boolean, owner string, chamber string, price double, size bigint, size_range_high bigint, size_range_low bigint, value bigint, filing_id bigint, filing_url string, reporting_gap bigint, comment string, committees array<string>, labels array<string>, asset_type string, ticker string, trade_date_price double, current_price double, price_enriched_at timestamp, estimated_shares double, estimated_value double, price_source string, benchmark_price double, enriched_at timestamp"
_DDL["POLITICIANS"] = "politician_id string, state string, party string, party_other string, district string, first_name string, last_name string, nickname string, middle_name string, full_name string, dob string, gender string, social_facebook string, social_twitter string, social_youtube string, website string, chamber string, committees array<string>, enriched_at timestamp"
_DDL["ISSUERS"] = "issuer_id bigint, state string, c2iq string, country string, issuer_name string, ticker string, sector string, gics_sector string, enriched_at timestamp"
_DDL["STATS"] = "id string, count_trades bigint, count_others bigint, volume bigint, date_last_traded date"
_DDL["EOD_PRICES"] = "issuer_id bigint, price_date date, price double"
_DDL["POSITIONS"] = "politician_id string, ticker string, shares_held double, cost_basis double, realized_pnl double, last_updated timestamp"
_DDL["FEC_MAPPINGS"] = "politician_id string, fec_candidate_id string, bioguide_id string, committee_ids array<string>, election_cycle int, last_synced timestamp"
_DDL["FEC_COMMITTEES"] = "committee_id string, name string, committee_type string, designation string, party string, state string, cycles array<int>, last_synced timestamp"
_DDL["DONATIONS"] = "sub_id string, committee_id string, contributor_name string, contributor_state string, contributor_employer string, contributor_occupation string, receipt_date date, amount double, cycle int"
_DDL["DONATION_SYNC"] = "politician_id string, committee_id string, cycle int, last_index bigint, last_date string, last_synced timestamp, total_synced bigint"
_DDL["EMPLOYER_MAPPINGS"] = "normalized_employer string, issuer_id bigint, issuer_ticker string, confidence double, match_type string, last_updated timestamp"
_DDL["EMPLOYER_LOOKUP"] = "raw_employer_lower string, normalized_employer string"
_DDL["SECTOR_BENCHMARKS"] = "sector string, etf_ticker string, etf_name string"

_DDL["FEED_TRADE"] = "_txId bigint, _politicianId string, _assetId bigint, _issuerId bigint, pubDate timestamp, filingDate date, txDate date, txType string, txTypeExtended string, hasCapitalGains boolean, owner string, chamber string, price double, size bigint, sizeRangeHigh bigint, sizeRangeLow bigint, value bigint, filingId bigint, filingURL string, filingUrl string, reportingGap bigint, comment string, committees array<string>, labels array<string>, assetType string, asset struct<assetType:string,assetTicker:string,instrument:string>, issuer struct<_stateId:string,c2iq:string,country:string,issuerName:string,issuerTicker:string,sector:string>, politician struct<_stateId:string,chamber:string,dob:string,firstName:string,gender:string,lastName:string,nickname:string,party:string>"
_DDL["FEED_POLITICIAN"] = "_politicianId string, _stateId string, party string, partyOther string, district string, firstName string, lastName string, nickname string, middleName string, fullName string, dob string, gender string, socialFacebook string, socialTwitter string, socialYoutube string, website string, chamber string, committees array<string>, stats struct<dateLastTraded:date,countTrades:bigint,countIssuers:bigint,volume:bigint>"
_PERFORMANCE = ["mcap", *[f"trailing{d}{c}" for d in (1, 7, 30, 90, 365) for c in ("", "Change")], *[f"{p}{c}" for p in ("wtd", "mtd", "qtd", "ytd") for c in ("", "Change")]]
PERFORMANCE_FIELDS = tuple(_PERFORMANCE)
_DDL["FEED_ISSUER"] = "_issuerId bigint, _stateId string, c2iq string, country string, issuerName string, issuerTicker string, sector string, performance struct<eodPrices:array<array<string>>," + ",".join(f"{f}:{'bigint' if f == 'mcap' else 'double'}" for f in _PERFORMANCE) + ">, stats struct<countTrades:bigint,countPoliticians:bigint,volume:bigint,dateLastTraded:date>"
_DDL["FEED_CONTRIBUTION"] = "sub_id string, committee struct<committee_id:string,name:string>, contributor_name string, contributor_state string, contributor_employer string, contributor_occupation string, contribution_receipt_date date, contribution_receipt_amount double"
_DDL["FEED_COMMITTEE"] = "committee_id string, name string, committee_type string, designation string, party string, state string, cycles array<int>"
_DDL["FEED_LEGISLATOR"] = "id struct<bioguide:string,fec:array<string>>, name struct<first:string,last:string,official_full:string>, terms array<struct<type:string,start:string,end:string,state:string,party:string>>"
