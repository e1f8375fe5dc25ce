"""Device, browser, system and in-app browser from a user agent. The ordered patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BROWSERS = [("edg/", "edge"), ("opr/|opera", "opera"), ("firefox/", "firefox"), ("chrome/", "chrome"), ("safari/", "safari")]
SYSTEMS = [("openharmony|harmonyos", "harmonyos"), ("windows nt", "windows"), ("iphone|ipad|ipod", "ios"), ("android", "android"), ("cros", "chromeos"), ("mac os x|macintosh", "macos"), ("linux", "linux")]
APPS = [("micromessenger", "wechat"), ("dingtalk", "dingtalk"), ("alipayclient", "alipay"), ("weibo", "weibo"), ("lark|feishu", "lark"), ("aweme|douyin|bytedancewebview", "douyin")]


def has(ua: Column, pattern: str) -> Column:
    return F.coalesce(ua, F.lit("")).rlike(f"(?i){pattern}")


def first_of(ua: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    out = F.when(has(ua, rules[0][0]), rules[0][1])
    for pattern, name in rules[1:]:
        out = out.when(has(ua, pattern), name)
    return out.otherwise(otherwise)


def device(ua: Column) -> Column:
    android = F.when(has(ua, "mobile"), "mobile").otherwise("tablet")
    return F.when(has(ua, "ipad"), "tablet").when(has(ua, "android"), android).when(has(ua, "iphone|ipod|mobi"), "mobile").otherwise("desktop")


def browser(ua: Column) -> Column:
    return first_of(ua, BROWSERS, "other")


def system(ua: Column) -> Column:
    return first_of(ua, SYSTEMS, "other")


def app(ua: Column) -> Column:
    qq = has(ua, r"(?<![a-z0-9_])qq/[0-9.]+") & ~has(ua, "mqqbrowser")
    return F.when(first_of(ua, APPS, "none") != "none", first_of(ua, APPS, "none")).when(qq, "qq").otherwise("none")
