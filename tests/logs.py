"""Log entries used by several tests."""


def user(text, ts="2026-04-20T10:00:00Z", **more):
    return {"type": "user", "timestamp": ts, "message": {"content": text}, **more}


def reply(msg_id, usage, model="claude-opus-4-7", ts="2026-04-20T10:00:01Z"):
    message = {"id": msg_id, "model": model, "content": []}
    if usage is not None:
        message["usage"] = usage
    return {"type": "assistant", "timestamp": ts, "message": message}


def usage(i=0, o=0, read=0, write=0, hour=None):
    out = {
        "input_tokens": i,
        "output_tokens": o,
        "cache_read_input_tokens": read,
        "cache_creation_input_tokens": write,
    }
    if hour is not None:
        out["cache_creation"] = {"ephemeral_1h_input_tokens": hour}
    return out


def meta(session="s1", ts="2026-04-20T10:00:00Z", **payload):
    return {"type": "session_meta", "timestamp": ts, "payload": {"id": session, **payload}}


def context(model, ts="2026-04-20T10:00:00Z"):
    return {"type": "turn_context", "timestamp": ts, "payload": {"model": model}}


def event(kind, ts="2026-04-20T10:00:01Z", **payload):
    return {"type": "event_msg", "timestamp": ts, "payload": {"type": kind, **payload}}


def tokens(total, last=None, ts="2026-04-20T10:00:02Z"):
    info = {"total_token_usage": total}
    if last is not None:
        info["last_token_usage"] = last
    return event("token_count", ts=ts, info=info)


def total(i=None, cached=None, o=None, create=None):
    named = {
        "input_tokens": i,
        "cached_input_tokens": cached,
        "output_tokens": o,
        "cache_creation_input_tokens": create,
    }
    return {k: v for k, v in named.items() if v is not None}
