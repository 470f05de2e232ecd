from datetime import date

from logs import context, event, meta, tokens, total
from meterstone.functions.pricebook import BUILTIN
from meterstone.operators import log_b
from meterstone.sources import registry
from meterstone.sources.logs import read_agent_b


def test_rows_are_kept_without_what_only_their_state_was_made_of(spark, tmp_path, write_log, monkeypatch):
    entries = [meta("s", forked_from_id="p"), event("user_message", message="a"), tokens(total(50, 5, 1)), context("gpt-5.4")]
    entries += [event("user_message", message="b"), tokens(total(100, 10, 2))]
    write_log(tmp_path / "logs" / "rollout-s.jsonl", entries)
    lines = read_agent_b(spark, str(tmp_path / "logs"))
    kept = []

    def keep(df):
        kept.append(df.columns)
        return df

    monkeypatch.setattr(registry, "cut_lineage", keep)
    events, files = registry.agent_b(str(tmp_path / "logs")).normalise(lines, date(2026, 4, 30), BUILTIN)
    assert not {"base", "meta_forked", *log_b.COUNTERS} & set(kept[-1])
    resolved = log_b.resolve_state(log_b.parse_lines(lines))
    for got, want in ((events, log_b.events_b(resolved)), (files, log_b.files_b(resolved))):
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
