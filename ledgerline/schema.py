"""Types and closed value sets of the filing model."""

from __future__ import annotations

from pyspark.sql import types as T

JOB_STATES = ("pending", "parsing", "extracting", "translating", "assembling", "complete", "failed", "duplicate")
ACTIVE_STATES = JOB_STATES[1:5]
TERMINAL_STATES = ("complete", "failed")
LANGUAGES = ("en", "et", "lv", "lt")
REPORT_TYPES = ("annual", "q1", "q2", "q3", "q4", "semi-annual", "other")
METRIC_IDS = ("revenue", "ebitda", "net_profit", "free_cash_flow", "operating_cash_flow", "capex", "total_assets", "equity", "liabilities", "eps", "dividends")
CANDIDATE_STATUS = ("pending_review", "failed_quality", "approved", "rejected")
GUIDANCE = ("raised", "maintained", "lowered")
DOCUMENT_CLASSES = ("financial_report", "auditor_report", "legal_filing", "prospectus", "press_release", "low_quality_text", "unknown")
SEVERITIES = ("low", "medium", "high")


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_S, _D, _I = T.StringType(), T.DoubleType(), T.IntegerType()
EVIDENCE = _struct(page=_I, chunkIndex=_I, snippet=_S, confidence=_D, rationale=_S)
METRIC = _struct(label=_S, value=_D, unit=_S, period=_S, canonicalId=_S, originalLabel=_S, originalUnit=_S, normalizedValue=_D, normalizedUnit=_S, evidence=EVIDENCE)
NARRATIVE = _struct(section=_S, text=_S)
#: A breakdown's value may come as text ("1,200", "45%").
BREAKDOWN_ENTRY = _struct(name=_S, value=_S)
SNAPSHOT = _struct(
    metadata=_struct(companyName=_S, reportPeriod=_S, sourceLanguage=_S, outputLanguage=_S, evidence=_struct(companyName=EVIDENCE, reportPeriod=EVIDENCE)),
    metrics=T.ArrayType(METRIC),
    narratives=T.ArrayType(NARRATIVE),
    sentiment=_struct(managementTone=_S, outlook=_S, riskFactors=T.ArrayType(_S), guidanceDirection=_S),
    revenueBreakdown=_struct(bySegment=T.ArrayType(BREAKDOWN_ENTRY), byGeography=T.ArrayType(BREAKDOWN_ENTRY)),
    profitabilityTrends=_struct(periods=T.ArrayType(_S), revenue=T.ArrayType(_D), ebitda=T.ArrayType(_D), netProfit=T.ArrayType(_D), freeCashFlow=T.ArrayType(_D)),
    chartWarnings=T.ArrayType(_S),
)

TS = T.TimestampType()
JOBS = _struct(id=_S, state=_S, original_filename=_S, output_language=_S, extracted_text=_S, extracted_json=_S, error=_S, company_id=_S, created_at=TS, updated_at=TS)
TRANSLATIONS = _struct(source_text=_S, et=_S, lv=_S, lt=_S, created_at=TS, updated_at=TS)
LEADS = _struct(id=_S, email=_S, company=_S, role=_S, use_case=_S, message=_S, source=_S, utm_source=_S, utm_medium=_S, utm_campaign=_S, user_agent=_S, referrer=_S, ip_address=_S, created_at=TS, updated_at=TS)
COMPANIES = _struct(id=_S, name=_S, ticker=_S, exchange=_S, slug=_S, country=_S, sector=_S, created_at=TS, updated_at=TS)
REPORTS = _struct(id=_S, company_id=_S, fiscal_year=_I, report_type=_S, language=_S, job_id=_S, s3_key=_S, extracted_json_snapshot=_S, created_at=TS)
CANDIDATES = _struct(id=_S, report_id=_S, job_id=_S, s3_key=_S, extracted_json_snapshot=_S, status=_S, quality_warnings=_S, created_at=TS, approved_at=TS)
MANIFEST = _struct(file=_S, company_slug=_S, fiscal_year=_I, report_type=_S, output_language=_S)
TABLES = {"jobs": JOBS, "translation_cache": TRANSLATIONS, "leads": LEADS, "companies": COMPANIES, "reports": REPORTS, "report_rerun_candidates": CANDIDATES}
