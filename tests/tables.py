"""Small tables for tests."""

CANDIDATE = "seq long, pass_no int, title string, category string, endpoint string, symbol string, file string, line int, severity string, evidence string, status string, source string, found_by array<string>"
FINDING = "seq long, file string, line int, severity string, category string, description string, exploit_scenario string, recommendation string, confidence double"


def candidates(spark, rows):
    base = {"pass_no": 1, "title": "t", "category": "replay", "endpoint": "", "symbol": "", "file": "a.py", "line": None, "severity": "HIGH", "evidence": "", "status": "open", "source": "s", "found_by": ["m"]}
    names = [c.split()[0] for c in CANDIDATE.split(", ")]
    full = [base | {"seq": i} | r for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], CANDIDATE)


def findings(spark, rows):
    base = {"file": "a.py", "line": 1, "severity": "HIGH", "category": "replay", "description": "d", "exploit_scenario": "", "recommendation": "", "confidence": 0.9}
    names = [c.split()[0] for c in FINDING.split(", ")]
    full = [base | {"seq": i} | r for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], FINDING)


def column(df, name):
    return [r[name] for r in df.collect()]
