"""Pieces of checking SQL used by several queries."""

EFFECTIVE = "coalesce(started_at, queued_at, completed_at)"


def trimmed(c: str) -> str:
    return f"lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'))"


def executed(c: str) -> str:
    return f"(case when {trimmed(c)} = 'cancelled' then 'canceled' else {trimmed(c)} end)"


def display(c: str) -> str:
    return (
        f"(case {trimmed(c)} when 'cancelled' then 'canceled' when 'in_progress' then 'running' "
        f"when 'failed' then 'failed' when 'canceled' then 'canceled' when 'running' then 'running' "
        f"when 'queued' then 'queued' when 'success' then 'success' when 'skipped' then 'skipped' else 'pending' end)"
    )


def state(c: str) -> str:
    return (
        f"(case when {trimmed(c)} in ('failed', 'canceled', 'cancelled') then 'failed' "
        f"when {trimmed(c)} in ('success', 'skipped') then 'succeeded' else 'running' end)"
    )


def group_of(c: str) -> str:
    return (
        f"(case when {display(c)} in ('failed', 'canceled') then 'failed' when {display(c)} = 'running' then 'executing' "
        f"when {display(c)} in ('success', 'skipped') then 'succeeded' when {display(c)} = 'queued' then 'preparing' "
        f"else 'not_executed' end)"
    )


def rank_of(c: str) -> str:
    return (
        f"(case {display(c)} when 'failed' then 0 when 'canceled' then 1 when 'running' then 2 when 'queued' then 3 "
        f"when 'pending' then 4 when 'success' then 5 else 6 end)"
    )
