"""The same results as plain SQL, for checking against another engine.

Common table expressions over the `events` table; `RULES`, `STATUS` and the other small
tables are the literal inputs both sides share.
"""

from skeinwatch import schemas as S
from skeinwatch.sources.event_flows import FLOWS_SQL


def r(x: str, digits: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38,9)), {digits}) AS DOUBLE)"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def ratio(out: str, inn: str) -> str:
    return f"(CASE WHEN {inn} = 0 THEN CAST({out} AS DOUBLE) ELSE {r(f'CAST({out} AS DOUBLE) / {inn}', 4)} END)"


def entropy(x: str) -> str:
    return f"(CASE WHEN length({x}) <= 1 THEN 0.0 ELSE {r(f'list_entropy(string_split({x}, {chr(39)*2}))', 4)} END)"


def ngrams(x: str, n: int) -> str:
    grams = f"list_transform(range(1, length({x}) - {n - 2}), lambda i: substr({x}, i, {n}))"
    return f"(CASE WHEN length({x}) < {n} THEN 0.0 ELSE len(list_distinct({grams})) / CAST(len({grams}) AS DOUBLE) END)"


def frame(keys: str, seconds: int) -> str:
    return f"(PARTITION BY {keys} ORDER BY ts_us RANGE BETWEEN {seconds * 1000000} PRECEDING AND CURRENT ROW)"


SYN = "(flags = 'SYN')"

WINDOWS_SQL = f"""
wf0 AS (
  SELECT *,
    count(*) OVER tw AS t10_count,
    {big(f"sum(CASE WHEN {SYN} THEN 1 ELSE 0 END) OVER tw")} AS t10_syn,
    {big("sum(bytes_out) OVER tw")} AS t10_bytes,
    count(DISTINCT src_ip) OVER tw AS t10_sources,
    count(*) OVER sw AS s10_count,
    {big(f"sum(CASE WHEN {SYN} THEN 1 ELSE 0 END) OVER sw")} AS s10_syn,
    {big("sum(bytes_out) OVER sw")} AS s10_bytes,
    count(DISTINCT concat(dst_ip, ':', CAST(dst_port AS VARCHAR))) OVER sw AS s10_fan_out,
    count(*) OVER rw AS s60_probes,
    count(DISTINCT dst_ip) OVER rw AS s60_ips,
    count(DISTINCT dst_port) OVER rw AS s60_ports,
    count(*) OVER xw AS f300_count,
    {big("sum(bytes_out) OVER xw")} AS f300_bytes_out,
    {big("sum(bytes_in) OVER xw")} AS f300_bytes_in,
    list_sort(list(ts_us) OVER xw) AS st
  FROM fl
  WINDOW tw AS {frame("dst_ip, dst_port", 10)}, sw AS {frame("src_ip", 10)},
         rw AS {frame("src_ip", 60)}, xw AS {frame("flow_id", 300)}),
wf1 AS (
  SELECT *, list_transform(range(2, len(st) + 1), lambda i: (st[i] - st[i - 1]) / 1000000.0) AS d FROM wf0),
wf2 AS (
  SELECT *, CASE WHEN len(d) = 0 THEN 0.0 ELSE list_sum(d) / len(d) END AS mu FROM wf1),
wf3 AS (
  SELECT *, CASE WHEN len(d) < 2 THEN 0.0
     ELSE list_sum(list_transform(d, lambda x: (x - mu) * (x - mu))) / len(d) END AS var FROM wf2),
wf AS MATERIALIZED (
  SELECT * EXCLUDE (st, d, mu, var),
    CASE WHEN len(d) < 2 THEN 0.0 ELSE mu END AS iat_mean,
    {r("var", 6)} AS iat_variance,
    sqrt(var) AS iat_stddev,
    CASE WHEN len(d) < 2 THEN 0.0 ELSE {r("1 - least(sqrt(var) / greatest(mu, 0.0001), 1.0)", 4)} END AS iat_concentration,
    CASE WHEN len(d) < 2 THEN 0.0 WHEN var <= 0.000001 THEN 1.0 ELSE
      {r("greatest(-1.0, least(1.0, list_sum(list_transform(range(1, len(d)), lambda i: (d[i] - mu) * (d[i + 1] - mu))) / greatest(var * len(d), 0.000001)))", 4)}
    END AS iat_autocorr,
    CASE WHEN len(st) <= 1 THEN 0.0 ELSE
      abs({r("list_entropy(list_transform(st, lambda x: (x + 50000) // 100000))", 4)}) END AS stamp_entropy,
    {ratio("f300_bytes_out", "f300_bytes_in")} AS f300_byte_ratio
  FROM wf3)
"""

_FAMILY = "CASE lower(ja3_hash) " + " ".join(
    f"WHEN '{h}' THEN '{f}'" for h, f in S.JA3_SIGNATURES.items()
) + " END"

_BASE = "seq, ts_us, flow_id, src_ip, src_port, dst_ip, dst_port, protocol, bytes_out, bytes_in, packets_out, packets_in, dns_query, dns_query_type, flags"
_RATIO = ratio("bytes_out", "bytes_in")
_NONE = {
    "var": "0.0", "ent": "0.0", "br": "0.0", "fan": "1", "ja3": "NULL", "inb": "NULL", "outb": "NULL",
    "ports": "NULL", "win": "NULL", "conc": "NULL", "period": "NULL", "std": "NULL", "ngram": "NULL",
    "pps": "NULL", "z": "NULL", "hosts": "NULL", "uports": "NULL", "f10": "NULL", "f60": "NULL",
    "sources": "NULL", "upload": "NULL",
}
_TYPES = {
    "var": "DOUBLE", "ent": "DOUBLE", "br": "DOUBLE", "fan": "BIGINT", "ja3": "VARCHAR", "inb": "BIGINT",
    "outb": "BIGINT", "ports": "BIGINT", "win": "INTEGER", "conc": "DOUBLE", "period": "DOUBLE",
    "std": "DOUBLE", "ngram": "DOUBLE", "pps": "DOUBLE", "z": "DOUBLE", "hosts": "BIGINT",
    "uports": "BIGINT", "f10": "BIGINT", "f60": "BIGINT", "sources": "BIGINT", "upload": "BIGINT",
}


def _cand(cls: str, conf: str, details: str, source: str, where: str, **fields) -> str:
    vals = {**_NONE, **fields}
    cols = ", ".join(f"CAST({vals[k]} AS {t}) AS {k}" for k, t in _TYPES.items())
    order = S.THREAT_CLASSES.index(cls)
    return (
        f"SELECT {_BASE}, '{cls}' AS threat_class, {order} AS class_no, {r(conf, 4)} AS conf, "
        f"{cols}, {details} AS details FROM {source} WHERE {where}"
    )


DDOS_SQL = f"""
dd0 AS (SELECT *, {r("t10_count / 10.0", 2)} AS win_pps, {SYN} AS is_syn FROM wf),
dd1 AS (SELECT *, greatest(CAST(packets_in AS DOUBLE), CAST(packets_out AS DOUBLE), win_pps) AS pps,
  t10_syn + CASE WHEN is_syn THEN 1 ELSE 0 END AS syn_count FROM dd0),
dd2 AS (SELECT *, (pps - 50.0) / 30.0 AS z,
  CASE WHEN is_syn THEN CAST(syn_count AS DOUBLE) / greatest(t10_count, 1) ELSE 0.0 END AS syn_ratio FROM dd1),
dd3 AS (SELECT *, (is_syn AND packets_in >= 300) OR (syn_ratio >= 0.85 AND pps >= 100.0) AS flood,
  protocol = 'UDP' AND pps >= 200.0 AND z >= 3.0 AS udp, z >= 3.0 AND pps >= 100.0 AS surge,
  least(0.99, 0.75 + least(0.24, (z - 3.0) * 0.03)) AS base_conf FROM dd2),
c_ddos AS ({_cand(
    S.DDOS, "CASE WHEN flood THEN greatest(base_conf, 0.92) ELSE base_conf END",
    "concat(CASE WHEN flood AND t10_sources > 1 THEN 'Distributed SYN Flood' WHEN flood THEN 'SYN Flood / DoS' "
    "WHEN udp THEN 'UDP Storm' ELSE 'Volumetric PPS Surge' END, ' detected targeting ', dst_ip, ': ', "
    f"printf('%.1f', {r('pps', 1)}), ' PPS from ', CAST(t10_sources AS VARCHAR), ' source(s) (Z-score=', "
    f"printf('%.2f', {r('z', 2)}), ' > 3.0σ, SYN ratio=', printf('%.2f', {r('syn_ratio', 2)}), ').')",
    "dd3", "packets_in > packets_out AND (flood OR udp OR surge)",
    br=_RATIO, inb="syn_count", outb="packets_out", win="10", pps="pps", z="z", sources="t10_sources")})
"""
BEACON_SQL = f"""
c_beacon AS ({_cand(
    S.BEACON,
    "least(0.99, 0.82 + least(0.12, (0.05 - least(iat_variance, 0.05)) * 2.0) + least(0.05, (f300_count - 3) * 0.01))",
    f"concat('Periodic C2 beaconing detected at ', printf('%.1f', {r('iat_mean', 1)}), "
    "'s intervals via FFT harmonic analysis (', CAST(f300_count AS VARCHAR), ' heartbeats, IAT variance=', "
    f"printf('%.6f', iat_variance), 's², concentration=', printf('%.2f', {r('iat_concentration', 2)}), ').')",
    "wf",
    "f300_count >= 3 AND iat_mean >= 1.0 AND (iat_variance <= 0.05 OR iat_concentration >= 0.85 OR iat_autocorr >= 0.70)",
    var="iat_variance", ent="stamp_entropy", br="f300_byte_ratio", ja3="ja3_hash",
    conc="iat_concentration", period="iat_mean", std="iat_stddev")})
"""
DNS_SQL = f"""
dn0 AS (SELECT *, split_part(dns_query, '.', 1) AS label, length(dns_query) AS qlen FROM fl WHERE dns_query IS NOT NULL),
dn1 AS (SELECT *, greatest({entropy("dns_query")}, {entropy("label")}) AS h,
  {ngrams("dns_query", 2)} AS bi, {ngrams("dns_query", 3)} AS tri FROM dn0),
c_dns AS ({_cand(
    S.DGA,
    "least(0.99, 0.80 + least(0.12, greatest(0.0, (h - 3.8) * 0.3)) + CASE WHEN qlen >= 60 THEN 0.06 ELSE 0.0 END "
    "+ CASE WHEN dns_query_type IN ('TXT', 'NULL') THEN 0.05 ELSE 0.0 END + CASE WHEN tri > 0.80 THEN 0.03 ELSE 0.0 END)",
    "concat(CASE WHEN qlen >= 60 OR (dns_query_type IN ('TXT', 'NULL') AND (qlen >= 45 OR h >= 3.6)) "
    "THEN 'DNS Tunneling (TXT/Payload)' ELSE 'DGA Generation' END, ' detected on query ''', substr(dns_query, 1, 50), "
    f"''': Shannon entropy=', printf('%.2f', {r('h', 2)}), ' (threshold=3.80), length=', CAST(qlen AS VARCHAR), "
    "' chars, record_type=', dns_query_type, '.')",
    "dn1", "h >= 3.8 OR qlen >= 60 OR (dns_query_type IN ('TXT', 'NULL') AND (qlen >= 45 OR h >= 3.6))",
    ent="h", br=_RATIO, ngram=r("bi", 4))})
"""
MALWARE_SQL = f"""
mw AS (SELECT *, {_FAMILY} AS family FROM fl),
c_malware AS ({_cand(
    S.MALWARE, "0.96",
    "concat('Malicious TLS ClientHello fingerprint matched (', ja3_hash, '): attributed to ', family, ' (ports: ', CAST(dst_port AS VARCHAR), ').')",
    "mw", "family IS NOT NULL", br=_RATIO, ja3="ja3_hash")})
"""
RECON_SQL = f"""
rc0 AS (SELECT *, greatest(s60_ports, s60_ips, s10_fan_out) AS card FROM wf),
c_recon AS ({_cand(
    S.RECON, "least(0.98, 0.80 + least(0.18, (greatest(card, 3) - 3) * 0.03))",
    "concat('Reconnaissance ', CASE WHEN s60_ports >= s60_ips THEN 'Port Scan' ELSE 'Subnet Sweep' END, ' detected from ', "
    "src_ip, ': ', CAST(greatest(card, 3) AS VARCHAR), ' unique target endpoints probed in window (target: ', dst_ip, ':', "
    "CAST(dst_port AS VARCHAR), ', bytes_out=', CAST(bytes_out AS VARCHAR), ').')",
    "rc0", f"card >= 3 AND ({SYN} OR bytes_in = 0) AND bytes_out <= 100 AND packets_out <= 2",
    ent="1.0", br=_RATIO, fan="greatest(card, 3)", ports="s60_ports", win="60", hosts="s60_ips", uports="s60_ports",
    f10="s10_fan_out", f60="greatest(s60_ips, s60_ports)")})
"""
EXFIL_SQL = f"""
ex0 AS (SELECT *, greatest(bytes_out, f300_bytes_out) AS o, greatest(bytes_in, f300_bytes_in) AS i FROM wf),
ex1 AS (SELECT *, {ratio("o", "i")} AS ratio FROM ex0),
c_exfil AS ({_cand(
    S.EXFIL, "least(0.99, 0.82 + least(0.12, (o / 10000000.0) * 0.05) + least(0.05, (ratio / 100.0) * 0.05))",
    "concat('Data exfiltration anomaly detected from ', src_ip, ' -> ', dst_ip, ': ', format('{:,}', o), "
    f"' bytes egressed with ', printf('%.1f', {r('ratio', 1)}), 'x outbound asymmetry ratio.')",
    "ex1", "(o >= 1000000 AND ratio >= 20.0) OR (o >= 5000000 AND ratio >= 10.0)",
    br="ratio", inb="1", outb="1", win="300", upload="o")})
"""

_BITS = "1 << class_no"

CANDS_SQL = """
cands AS MATERIALIZED (
  SELECT * FROM c_ddos UNION ALL SELECT * FROM c_beacon UNION ALL SELECT * FROM c_dns
  UNION ALL SELECT * FROM c_malware UNION ALL SELECT * FROM c_recon UNION ALL SELECT * FROM c_exfil)
"""

ALERTS_SQL = f"""
rec AS (
  SELECT seq, ts_us, src_ip, count(*) AS n, bit_or({_BITS}) AS mask,
         string_agg(threat_class, ',' ORDER BY class_no) AS fired
  FROM cands GROUP BY seq, ts_us, src_ip),
brk AS (
  SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY src_ip ORDER BY ts_us, seq) <= 300000000
                 THEN 0 ELSE 1 END AS opens FROM rec),
isl AS (
  SELECT *, sum(opens) OVER (PARTITION BY src_ip ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING) AS island FROM brk),
inc AS (
  SELECT seq, n, fired,
    sha256(concat(src_ip, '|', CAST(min(ts_us) OVER (PARTITION BY src_ip, island) AS VARCHAR))) AS incident_id,
    bit_or(mask) OVER (PARTITION BY src_ip, island ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING) AS stage_mask
  FROM isl),
al0 AS (
  SELECT c.*, i.n, i.fired, i.incident_id, i.stage_mask, bit_count(i.stage_mask) AS stages,
    CASE WHEN i.n > 1 THEN 0.03 ELSE 0.0 END AS corr,
    CASE WHEN bit_count(i.stage_mask) >= 3 THEN 0.05 WHEN bit_count(i.stage_mask) = 2 THEN 0.02 ELSE 0.0 END AS chain
  FROM cands c JOIN inc i USING (seq)),
al1 AS (
  SELECT *, {r("least(1.0, greatest(0.0, conf + corr + chain))", 2)} AS confidence_score,
    list_aggregate(list_filter([{", ".join(
        f"CASE WHEN stage_mask & {1 << S.THREAT_CLASSES.index(c)} <> 0 THEN '{c}' END"
        for c in sorted(S.THREAT_CLASSES))}], lambda x: x IS NOT NULL), 'string_agg', ' -> ') AS chain_text
  FROM al0),
al AS MATERIALIZED (
  SELECT * RENAME (details AS raw_details, src_ip AS source_ip, dst_ip AS destination_ip,
                   src_port AS source_port, dst_port AS destination_port),
    CASE WHEN confidence_score >= 0.95 THEN 'critical' WHEN confidence_score >= 0.90 THEN 'high'
         WHEN confidence_score >= 0.80 THEN 'moderate' ELSE 'low' END AS severity,
    sha256(concat(flow_id, '|', CAST(ts_us AS VARCHAR), '|', CAST(seq AS VARCHAR), '|', threat_class)) AS alert_id,
    CASE WHEN stages > 1 THEN concat('[Attack Chain: ', chain_text, '] ', details) ELSE details END AS details
  FROM al1)
"""

FLOWS = "WITH " + FLOWS_SQL
WINDOWS = FLOWS + ", " + WINDOWS_SQL
CANDIDATES = ", ".join(
    [WINDOWS, DDOS_SQL, BEACON_SQL, DNS_SQL, MALWARE_SQL, RECON_SQL, EXFIL_SQL, CANDS_SQL]
)
ALERTS = CANDIDATES + ", " + ALERTS_SQL
