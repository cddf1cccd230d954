"""The dated list that op1_url_filters applies, and when pages count as fetched."""

from __future__ import annotations

#: (list, kind, pattern, action, event, date) (fixed values).
EVENTS = (
    ("curated", "domain", "cheap-pills.example.com", "block", "add", "2023-11-20"),
    ("curated", "host", "www.cheap-pills.example.com", "allow", "add", "2024-03-01"),
    ("curated", "host", "www.cheap-pills.example.com", "allow", "remove", "2024-05-15"),
    ("curated", "domain", "cheap-pills.example.com", "block", "remove", "2024-08-01"),
    ("curated", "domain", "cheap-pills.example.com", "block", "add", "2024-10-10"),
    ("curated", "domain", "spam-farm.example.org", "block", "add", "2024-02-01"),
    ("curated", "prefix", "spam-farm.example.org/de", "allow", "add", "2024-06-01"),
    ("community", "domain", "spam-farm.example.org", "block", "add", "2023-06-01"),
    ("community", "domain", "spam-farm.example.org", "block", "remove", "2024-04-01"),
    ("community", "prefix", "spam-farm.example.org/en", "block", "add", "2024-01-15"),
    ("community", "domain", "casino-win.example.net", "block", "add", "2024-01-01"),
    ("community", "domain", "example.net", "allow", "add", "2024-01-01"),
    ("community", "domain", "example.net", "block", "add", "2024-09-01"),
    ("community", "domain", "example.net", "allow", "add", "2024-09-15"),
    ("community", "host", "blog.ththan.example.net", "block", "add", "2024-07-01"),
    ("community", "prefix", "m.ththth.example.net/en", "block", "add", "2024-04-01"),
    ("community", "url", "ththin.example.com/en/671?utm_source=feed", "block", "add", "2024-01-01"),
)

#: Pages carry no time. Their ids are spread over the minutes of 2024 by this step.
FIRST_MINUTE, MINUTES, STEP = "2024-01-01 00:00:00", 366 * 24 * 60, 7919
