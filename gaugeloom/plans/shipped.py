"""Shipped definitions."""

from __future__ import annotations

DISK = """
schema = 1
[monitor]
name = "disk"
source = "disk"
interval = "60s"
[[derived]]
name = "filling"
expr = "monot(used_bytes, '70m')"
[[derived]]
name = "fill_rate_bph"
expr = "slope(used_bytes, '70m') * 3600"
[[derived]]
name = "full_in_h"
expr = "free_bytes / clamp(fill_rate_bph, 1, 1e15)"
[[derived]]
name = "free_mb"
expr = "free_bytes / MB"
[[rule]]
name = "space-warn"
group = "space"
when = "used_pct >= 85"
severity = "warning"
confirm_cycles = 2
[[rule]]
name = "space-error"
group = "space"
when = "used_pct >= 92"
severity = "error"
confirm_cycles = 2
[[rule]]
name = "space-critical"
group = "space"
when = "used_pct >= 97"
severity = "critical"
[[rule]]
name = "inodes"
when = "inode_used_pct >= 80"
severity = "warning"
[[rule]]
name = "filling"
when = "filling >= 0.85 and used_pct > 50"
severity = "notice"
[[trend]]
name = "capacity"
value = "used_bytes"
rate = "fill_rate_bph"
remaining = "free_bytes"
confidence = "filling"
least_confidence = 0.5
"""

LEAK = """
schema = 1
[monitor]
name = "leak"
source = "process"
interval = "60s"
[parameters]
warn_mb_h = 32
crit_mb_h = 128
[promotion]
when = "monot(rss_bytes, '15m') >= 0.8 and delta(rss_bytes, '15m') > 4 * MB"
[[derived]]
name = "growth_bph"
expr = "slope(rss_bytes, '45m') * 3600"
[[rule]]
name = "leak-warn"
group = "leak"
when = "coverage(rss_bytes, '45m') >= 0.8 and delta(rss_bytes, '45m') > 16 * MB and growth_bph > warn_mb_h * MB"
severity = "warning"
confirm_cycles = 3
[[rule]]
name = "leak-crit"
group = "leak"
when = "coverage(rss_bytes, '45m') >= 0.8 and delta(rss_bytes, '45m') > 16 * MB and growth_bph > crit_mb_h * MB"
severity = "critical"
confirm_cycles = 3
[[trend]]
name = "growth"
value = "rss_bytes"
rate = "growth_bph"
"""

HOG = """
schema = 1
[monitor]
name = "hog"
source = "process"
interval = "60s"
[[rule]]
name = "cpu-hog"
group = "cpu"
when = "avg(cpu_pct, '5m') > 80"
severity = "notice"
confirm_cycles = 5
[[rule]]
name = "cpu-hog-long"
group = "cpu"
when = "avg(cpu_pct, '15m') > 90"
severity = "warning"
confirm_cycles = 5
[[rule]]
name = "fds"
when = "pct(num_fds, fd_limit_soft) > 80"
severity = "warning"
"""

LOAD = """
schema = 1
[monitor]
name = "load"
source = "system"
interval = "60s"
[[rule]]
name = "cpu-pressure"
when = "avg(psi_some_cpu, '5m') > 40"
severity = "warning"
[[rule]]
name = "memory"
when = "pct(mem_used_bytes, mem_total_bytes) > 92"
severity = "warning"
[[rule]]
name = "swapping"
when = "slope(swap_used_pct, '10m') * 60 > 1 and swap_used_pct > 20"
severity = "warning"
"""

NET = """
schema = 1
[monitor]
name = "net"
source = "net"
interval = "60s"
[[rule]]
name = "endpoint-gone"
when = "present == 0"
severity = "error"
confirm_cycles = 2
[[rule]]
name = "many-connections"
when = "conn_total > baseline(conn_total) * 4 and conn_total > 200"
severity = "warning"
"""

SERVICE = """
schema = 1
[monitor]
name = "service"
source = "unit"
interval = "60s"
[[rule]]
name = "down"
when = "present == 0"
severity = "error"
confirm_cycles = 2
[[rule]]
name = "restarting"
when = "delta(restarts, '30m') >= 3"
severity = "warning"
"""

EVENTS = """
schema = 1
[monitor]
name = "events"
source = "events"
[[rule]]
name = "oom"
when = "contains(message, 'Out of memory') or contains(message, 'oom-kill')"
severity = "error"
[[rule]]
name = "severe"
when = "severity >= error and not matches(provider, '^(audit|cron)')"
severity = "error"
"""

SHIPPED = {"disk": DISK, "leak": LEAK, "hog": HOG, "load": LOAD, "net": NET, "service": SERVICE, "events": EVENTS}
