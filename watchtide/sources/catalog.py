"""Typed fields of the flat log types, and their names in raw lines and in columns."""

from __future__ import annotations

from pyspark.sql import types as T

# Each log type's fields.
FIELDS: dict[str, dict[str, str]] = {
    "conn.log": {
        "conn.conn_state": "string",
        "conn.duration": "double",
        "conn.id.orig_h": "string",
        "conn.id.resp_h": "string",
        "conn.id.resp_p": "int",
        "conn.orig_bytes": "long",
        "conn.proto": "string",
        "conn.resp_bytes": "long",
        "conn.service": "string",
        "conn.ts": "time",
    },
    "dns.log": {
        "dns.answers": "strings",
        "dns.id.orig_h": "string",
        "dns.qtype": "int",
        "dns.qtype_name": "string",
        "dns.query": "string",
        "dns.rcode": "int",
        "dns.ts": "time",
    },
    "files.log": {
        "files.filename": "string",
        "files.md5": "string",
        "files.mime_type": "string",
        "files.rx_hosts": "strings",
        "files.sha1": "string",
        "files.source": "string",
        "files.ts": "time",
        "files.tx_hosts": "strings",
        "http.host": "string",
        "http.id.orig_h": "string",
        "http.id.resp_h": "string",
        "http.method": "string",
        "http.status_code": "int",
        "http.uri": "string",
        "http.user_agent": "string",
    },
    "ftp.log": {
        "ftp.arg": "string",
        "ftp.command": "string",
        "ftp.file_size": "long",
        "ftp.id.orig_h": "string",
        "ftp.id.resp_h": "string",
        "ftp.reply_code": "int",
        "ftp.ts": "time",
        "ftp.user": "string",
    },
    "http.log": {
        "files.filename": "string",
        "files.md5": "string",
        "files.mime_type": "string",
        "files.ts": "string",
        "http.filename": "string",
        "http.host": "string",
        "http.id.orig_h": "string",
        "http.id.resp_h": "string",
        "http.method": "string",
        "http.referrer": "string",
        "http.request_body_len": "long",
        "http.response_body_len": "long",
        "http.status_code": "int",
        "http.ts": "time",
        "http.uri": "string",
        "http.user_agent": "string",
    },
    "notice.log": {
        "notice.dst": "string",
        "notice.msg": "string",
        "notice.note": "string",
        "notice.src": "string",
        "notice.sub": "string",
        "notice.ts": "time",
    },
    "smb_files.log": {
        "conn.duration": "double",
        "conn.id.orig_h": "string",
        "conn.id.resp_h": "string",
        "conn.id.resp_p": "int",
        "conn.orig_bytes": "long",
        "conn.resp_bytes": "long",
        "conn.service": "string",
        "conn.ts": "time",
    },
    "ssh.log": {
        "ssh.auth_success": "boolean",
        "ssh.client": "string",
        "ssh.direction": "string",
        "ssh.id.orig_h": "string",
        "ssh.id.resp_h": "string",
        "ssh.server": "string",
        "ssh.ts": "time",
    },
    "ssl.log": {
        "ssl.cipher": "string",
        "ssl.id.orig_h": "string",
        "ssl.id.resp_h": "string",
        "ssl.id.resp_p": "int",
        "ssl.issuer": "string",
        "ssl.server_name": "string",
        "ssl.subject": "string",
        "ssl.ts": "time",
        "ssl.validation_status": "string",
        "ssl.version": "string",
    },
    "weird.log": {
        "weird.addl": "string",
        "weird.id.orig_h": "string",
        "weird.id.resp_h": "string",
        "weird.id.resp_p": "int",
        "weird.name": "string",
        "weird.ts": "time",
    },
}
_TYPES = {
    "string": T.StringType(),
    "strings": T.ArrayType(T.StringType()),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "time": T.DoubleType(),
}


def fields(log_type: str) -> dict[str, str]:
    """field -> kind; raises KeyError for an unknown log type."""
    return FIELDS[log_type]


def column(field: str) -> str:
    return field.replace(".", "__")


def raw_name(log_type: str, field: str) -> str:
    """The key of a raw line: without the log type's own prefix; a field of another log keeps its whole name."""
    return field.removeprefix(log_type.removesuffix(".log") + ".")


def raw_schema(log_type: str) -> T.StructType:
    return T.StructType([T.StructField(raw_name(log_type, f), _TYPES[k]) for f, k in fields(log_type).items()])


def names(log_type: str) -> dict[str, str]:
    """field -> column of decoded events."""
    return {f: column(f) for f in fields(log_type)}
