"""K3 to K7: comparisons and runs as text, JSON and HTML."""

from __future__ import annotations

import html
import json

from pyspark.sql import Row

from tracewright.operators.compare import Comparison, checks_of_runs, error_changes, improvements, low_sample, regressions, size_regressions, stable

SATURATION_WARN_PCT = 20.0
LISTS = ("regressions", "improvements", "stable", "low_sample", "size_regressions", "only_in_baseline", "only_in_candidate", "settings_diff", "flag_diff", "error_changes")
EXIT_OK, EXIT_ERROR, EXIT_REGRESSED, EXIT_ABORTED = 0, 1, 2, 130


def fmt_bytes(size: float) -> str:
    for bound, unit, name in ((1 << 10, 1, "B"), (1 << 20, 1 << 10, "KB"), (1 << 30, 1 << 20, "MB")):
        if size < bound:
            return f"{size / unit:.0f}{name}" if unit == 1 else f"{size / unit:.1f}{name}"
    return f"{size / (1 << 30):.1f}GB"


def fmt_ms(us: float) -> str:
    return f"{us / 1000:.3f}"


def fmt_pct(pct: float | None) -> str:
    return "n/a" if pct is None else f"{pct:+.1f}%"


def cut(text: str, n: int = 80) -> str:
    return text if len(text) <= n else text[:n] + "…"


def saturation_warning(run: dict) -> str | None:
    """C12."""
    s, flags = run.get("saturation") or {}, run["flags"]
    if (s.get("saturated_pct") or 0) < SATURATION_WARN_PCT:
        return None
    name, cap = ("--pool", flags["pool"]) if flags.get("pool") else ("--max-connections", flags["max_connections"])
    return f"all {cap} connections were taken while sessions waited in {s['saturated_samples']} of {s['samples']} samples ({s['saturated_pct']:.0f}%): {name} may have limited this run, not the server"


def run_table(run: dict, top: int = 10) -> str:
    """K5."""
    t, recorded = run["totals"], run["latency_source"] != "replayed"
    out = ["*** aborted: what follows is partial ***"] if run["aborted"] else []
    if run.get("aggregation"):
        out.append(f"{run['aggregation']['method']} of {run['aggregation']['passes']} passes")
    out.append(f"{'recorded' if recorded else 'replayed'}: {t['events']} events, {t['sessions']} sessions, {run['wall_secs']:.2f} s, {t['qps']:.1f} QPS")
    out.append(f"executed {t['executed']}, skipped {t['skipped']}, errors {t['errors']}, not run {t['not_run']}, connect failures {t['connect_failures']}, filtered {t['filtered']}")
    out.append("latencies are those that the capture recorded" if recorded else f"target: {run['target_server_version']} {run['target_url']}")
    if p := run.get("pacing"):
        out.append(f"paced at {p['speed']:g}x: {p['paced_events']} events, lag at most {p['max_lag_us'] / 1000:.1f} ms, {p['mean_lag_us'] / 1000:.1f} ms on average")
    if warning := saturation_warning(run):
        out.append(f"warning: {warning}")
    out += ["", f"{top} slowest classes by p95 (ms)", f"{'count':>8} {'errors':>7} {'p50':>10} {'p95':>10} {'p99':>10} {'max':>10} {'result':>9}  class"]
    shown = [c for c in run["fingerprints"] if c["count"] > 0]
    for c in shown[:top]:
        size = fmt_bytes(c["result_bytes"]["mean"]) if c.get("result_bytes") else "-"
        out.append(f"{c['count']:>8} {c['errors']:>7} {fmt_ms(c['p50_us']):>10} {fmt_ms(c['p95_us']):>10} {fmt_ms(c['p99_us']):>10} {fmt_ms(c['max_us']):>10} {size:>9}  {cut(c['fingerprint'])}")
    if len(shown) > top:
        out.append(f"… and {len(shown) - top} more")
    if failed := [c for c in run["fingerprints"] if c["errors"] > 0]:
        out += ["", "classes with errors", *[f"{c['errors']:>8}  {cut(c['fingerprint'])}: {c.get('first_error', '')}" for c in failed[:top]]]
    return "\n".join(out) + "\n"


def _plain(rows: list[Row]) -> list[dict]:
    return [{k: v for k, v in r.asDict(recursive=True).items() if k not in ("b", "c")} for r in rows]


def comparison_report(c: Comparison) -> dict:
    """K3: all of a comparison, collected: tables with a row for each class."""
    one = c.summary.first().asDict()
    base, cand = (r.first().asDict(recursive=True) for r in (c.base, c.cand))
    out = {"threshold_pct": c.threshold, "min_count": c.min_count}
    out |= {side: {k: v for k, v in run.items() if k != "fingerprints"} for side, run in (("baseline", base), ("candidate", cand))}
    frames = {
        "regressions": regressions(c.deltas),
        "improvements": improvements(c.deltas),
        "stable": stable(c.deltas),
        "low_sample": low_sample(c.deltas),
        "size_regressions": size_regressions(c.pairs),
        "only_in_baseline": c.only_base,
        "only_in_candidate": c.only_cand,
        "settings_diff": c.settings if base["target_settings"] and cand["target_settings"] else c.settings.limit(0),
        "flag_diff": c.flags,
        "error_changes": error_changes(c.deltas),
    }
    out |= {k: _plain(v.collect()) for k, v in frames.items()}
    if not (base["target_settings"] and cand["target_settings"]):
        out["settings_note"] = "settings are not compared: " + ("neither run has any" if not base["target_settings"] and not cand["target_settings"] else f"the {'candidate' if base['target_settings'] else 'baseline'} has none")
    sized = [any(f.get("result_bytes") for f in r["fingerprints"]) for r in (base, cand)]
    if not all(sized):
        out["size_note"] = "result sizes are not compared: " + ("neither run has any" if not any(sized) else f"the {'candidate' if sized[0] else 'baseline'} has none")
    if base["flags"]["checksum"] and cand["flags"]["checksum"]:
        rows = _plain(c.checks.collect())
        out["correctness"] = {"checked": one["checked"], "matched": one["matched"], "mismatches": [r for r in rows if r["status"] == "mismatch"], "advisory": [r for r in rows if r["status"] == "advisory"]}
    else:
        one["correctness_failed"] = False
    out["totals"] = c.totals().first().asDict()
    out |= {k: one[k] for k in ("count_mismatches", "size_buckets_checked", "regressed", "size_regressed", "correctness_failed")}
    out["exit_code"] = EXIT_REGRESSED if one["regressed"] or one["size_regressed"] or one["correctness_failed"] else EXIT_OK
    fires = {r.check for r in checks_of_runs(c.base, c.cand).where("fires").collect()}
    out["comparability_warnings"] = warnings(out, fires)
    return out


def warnings(report: dict, fires: set[str]) -> list[str]:
    """C1 to C11, in a fixed order; none of them decides the exit code."""
    b, c, out = report["baseline"], report["candidate"], []
    if "capture_file" in fires:
        out.append(f"capture files differ: {b['capture_file']} and {c['capture_file']}; the workloads may too")
    if "capture_dialect" in fires:
        out.append(f"capture dialects differ: {b['capture_dialect']} and {c['capture_dialect']}")
    if "engine_family" in fires:
        out.append("the targets are of different engine families, whose defaults differ; look through the settings")
    if "measurement_planes" in fires:
        out.append("MEASUREMENT PLANES: one side's latencies were recorded at the server or on the wire, the other's measured at a client; small differences mean nothing")
    out += [f"flag --{f['name']} differs: {f['baseline']} and {f['candidate']}" for f in report["flag_diff"]]
    out += [f"the {side} run was aborted; its numbers are partial" for side in ("baseline", "candidate") if report[side]["aborted"]]
    if report["settings_diff"]:
        out.append("settings differ: " + ", ".join(s["name"] for s in report["settings_diff"]))
    if "checksum_one_sided" in fires:
        out.append("one run only has checksums: results are not compared, and that run's latencies include reading all rows")
    if report["only_in_baseline"] or report["only_in_candidate"]:
        out.append(f"{len(report['only_in_baseline'])} classes are in the baseline only, {len(report['only_in_candidate'])} in the candidate only")
    if report["count_mismatches"]:
        out.append(f"{report['count_mismatches']} classes were executed a different number of times")
    if report["correctness_failed"]:
        out.append(f"RESULT MISMATCH: {len(report['correctness']['mismatches'])} deterministic classes returned different data")
    return out


def verdict(report: dict) -> str:
    why = [name for flag, name in (("regressed", f"{len(report['regressions'])} regressed classes"), ("size_regressed", f"{len(report['size_regressions'])} regressed size decades"), ("correctness_failed", "different results")) if report[flag]]
    return "FAIL: " + ", ".join(why) if why else "PASS"


def _delta_line(d: dict) -> str:
    return f"{fmt_pct(d['p95']['delta_pct']):>9} {fmt_ms(d['p95']['baseline_us']):>11} {fmt_ms(d['p95']['candidate_us']):>11} {d['baseline_count']:>8} {d['candidate_count']:>8}  {cut(d.get('bucket', '') + ' ' * ('bucket' in d) + d['fingerprint'])}"


def comparison_text(report: dict, top: int = 10) -> str:
    """K6."""
    t = report["totals"]
    out = [f"warning: {w}" for w in report["comparability_warnings"]]
    out += [verdict(report), f"QPS {t['baseline_qps']:.1f} to {t['candidate_qps']:.1f} ({fmt_pct(t['qps_delta_pct'])}), errors {t['baseline_errors']} to {t['candidate_errors']} ({t['error_delta']:+d})"]
    for name in ("regressions", "improvements", "size_regressions", "low_sample"):
        rows = report[name]
        out += ["", f"{name.replace('_', ' ')}: {len(rows)}"]
        if rows:
            out.append(f"{'p95':>9} {'before':>11} {'after':>11} {'count':>8} {'count':>8}  class")
        out += [_delta_line(d) for d in rows[:top]]
        if len(rows) > top:
            out.append(f"… and {len(rows) - top} more")
    out += ["", f"stable: {len(report['stable'])}"]
    out += [f"{d['error_delta']:+d} errors  {cut(d['fingerprint'])}" for d in report["error_changes"][:top]]
    for name in ("only_in_baseline", "only_in_candidate"):
        out += [f"{name.replace('_', ' ')}: {o['count']} times  {cut(o['fingerprint'])}" for o in report[name][:top]]
    out += [f"setting {s['name']}: {s['baseline']} to {s['candidate']}" for s in report["settings_diff"]]
    if k := report.get("correctness"):
        out.append(f"results: {k['checked']} classes checked, {k['matched']} matched, {len(k['mismatches'])} differ, {len(k['advisory'])} advisory")
    out += [report[n] for n in ("settings_note", "size_note") if n in report]
    return "\n".join(out) + "\n"


_STYLE = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse;margin:1em 0}td,th{border:1px solid #ccc;padding:.3em .6em;text-align:right}td:last-child,th:last-child{text-align:left;font-family:monospace}th{cursor:pointer}.fail{color:#b00}.pass{color:#070}"
_SCRIPT = "document.querySelectorAll('th').forEach(h=>h.onclick=()=>{const t=h.closest('table'),i=[...h.parentNode.children].indexOf(h),b=t.tBodies[0],d=h.dataset.d=h.dataset.d==='1'?'-1':'1';[...b.rows].sort((x,y)=>{const p=x.cells[i].dataset.v??x.cells[i].textContent,q=y.cells[i].dataset.v??y.cells[i].textContent,n=p-q;return d*(isNaN(n)?p.localeCompare(q):n)}).forEach(r=>b.append(r))})"


def _table(head: list[str], rows: list[list]) -> str:
    e = lambda x: html.escape(str(x), quote=True)
    cell = lambda x: f'<td data-v="{e(x[0])}">{e(x[1])}</td>' if isinstance(x, tuple) else f"<td>{e(x)}</td>"
    return "<table><thead><tr>" + "".join(f"<th>{e(h)}</th>" for h in head) + "</tr></thead><tbody>" + "".join("<tr>" + "".join(map(cell, r)) + "</tr>" for r in rows) + "</tbody></table>"


def comparison_html(report: dict) -> str:
    """K4: one page with no other files, whose tables sort by a click on a column."""
    e = lambda x: html.escape(str(x), quote=True)
    line = lambda d, kind: [kind, (d["p95"]["delta_pct"] if d["p95"]["delta_pct"] is not None else 1e308, fmt_pct(d["p95"]["delta_pct"])), fmt_ms(d["p95"]["baseline_us"]), fmt_ms(d["p95"]["candidate_us"]), d["baseline_count"], d["candidate_count"], d["fingerprint"]]
    parts = [f"<ul>{''.join(f'<li>{e(w)}</li>' for w in report['comparability_warnings'])}</ul>" if report["comparability_warnings"] else ""]
    parts.append(f"<h1 class={'fail' if report['exit_code'] else 'pass'}>{e(verdict(report))}</h1>")
    parts.append("<h2>Totals</h2>" + _table(["", "baseline", "candidate"], [[n, report["totals"][f"baseline_{n}"], report["totals"][f"candidate_{n}"]] for n in ("qps", "wall_secs", "executed", "errors")]))
    meta = ("capture_file", "capture_dialect", "latency_source", "target_server_version", "target_url", "started_at")
    parts.append("<h2>Runs</h2>" + _table(["", "baseline", "candidate"], [[n, report["baseline"].get(n) or "", report["candidate"].get(n) or ""] for n in meta]))
    parts.append("<h2>Settings</h2>" + (f"<p>{e(report['settings_note'])}</p>" if "settings_note" in report else _table(["name", "baseline", "candidate"], [[s["name"], s["baseline"], s["candidate"]] for s in report["settings_diff"]])))
    if k := report.get("correctness"):
        rows = [[kind, d["baseline_rows"], d["candidate_rows"], d["baseline_digest"], d["candidate_digest"], d["fingerprint"]] for kind in ("mismatches", "advisory") for d in k[kind]]
        parts.append(f"<h2>Results</h2><p>{k['checked']} checked, {k['matched']} matched</p>" + _table(["", "rows", "rows", "digest", "digest", "class"], rows))
    rows = [[d["bucket"], fmt_pct(d["p95"]["delta_pct"]), fmt_ms(d["p95"]["baseline_us"]), fmt_ms(d["p95"]["candidate_us"]), d["fingerprint"]] for d in report["size_regressions"]]
    parts.append("<h2>Size decades</h2>" + (f"<p>{e(report['size_note'])}</p>" if "size_note" in report else _table(["decade", "p95", "before", "after", "class"], rows)))
    parts.append("<h2>Classes</h2>" + _table(["verdict", "p95", "before (ms)", "after (ms)", "count", "count", "class"], [line(d, kind) for kind in ("regressions", "improvements", "stable", "low_sample") for d in report[kind]]))
    for name in ("only_in_baseline", "only_in_candidate"):
        parts.append(f"<h2>{e(name.replace('_', ' '))}</h2>" + _table(["count", "errors", "class"], [[o["count"], o["errors"], o["fingerprint"]] for o in report[name]]))
    return f"<!doctype html><html><head><meta charset=utf-8><title>Comparison</title><style>{_STYLE}</style></head><body>{''.join(parts)}<script>{_SCRIPT}</script></body></html>\n"


def to_json(report: dict) -> str:
    return json.dumps(report, indent=2, ensure_ascii=False, default=str) + "\n"
