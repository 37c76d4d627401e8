"""Table schemas. All TIMESTAMP columns are read in the session time zone."""

from __future__ import annotations

STEP = (
    "struct<action:string,selector:string,expected_url:string,detail:string,value:string,"
    "key:string,url:string,entry:string,direction:string,amount:int>"
)
STEPS = f"array<{STEP}>"
STRINGS = "array<string>"

TABLES: dict[str, str] = {
    "personas": (
        "name string, description string, purpose string, locale string, timezone string, "
        "profile string, context_summary string, created_at timestamp, last_used_at timestamp"
    ),
    "accounts": (
        "id bigint, persona string, service string, email string, creds_ref string, "
        "status string, created_at timestamp, notes string"
    ),
    "actions": "id bigint, persona string, action string, detail string, ts timestamp",
    "flows": (
        f"id bigint, domain string, action string, description string, confidence int, "
        f"steps {STEPS}, caveats {STRINGS}, refs {STRINGS}, created timestamp, "
        f"last_verified timestamp, last_failed timestamp"
    ),
    "milestones": (
        f"id bigint, persona string, event string, detail string, url string, tags {STRINGS}, "
        f"screenshot_path string, source string, ts timestamp"
    ),
    "context": (
        "id bigint, persona string, summary string, source string, tags string, "
        "created_at timestamp, updated_at timestamp, digested_at timestamp, deleted_at timestamp"
    ),
    "elements": (
        "page_id bigint, pos int, tag string, id string, name string, type string, role string, "
        "text string, value string, placeholder string, ariaLabel string, class string, "
        "src string, visible boolean"
    ),
    "page_meta": "page_id bigint, url string, title string",
    "steps": (
        "run_id bigint, step int, url string, page_type string, description string, "
        "action_taken string, tier string, confidence double"
    ),
    "flow_outcomes": (
        "id bigint, domain string, action string, run_id bigint, outcome string, ts timestamp"
    ),
    "recordings": "rec_id bigint, start_ms bigint, fps double",
    "frames": "rec_id bigint, frame_idx bigint, file string",
    "responses": "resp_id bigint, text string",
}

# Defaults of columns that older snapshots of a table may lack.
DEFAULTS: dict[str, dict[str, object]] = {
    "personas": {
        "description": "",
        "purpose": "",
        "profile": "",
        "context_summary": "",
        "locale": "en-US",
        "timezone": "UTC",
    },
    "accounts": {"email": "", "creds_ref": "", "status": "active", "notes": ""},
    "actions": {"detail": ""},
    "flows": {"description": "", "confidence": 0},
    "milestones": {"detail": "", "url": "", "screenshot_path": "", "source": "manual"},
}

# Foreign keys: child table -> (column, parent table, parent column).
PARENTS: dict[str, tuple[str, str, str]] = {
    "accounts": ("persona", "personas", "name"),
    "actions": ("persona", "personas", "name"),
    "milestones": ("persona", "personas", "name"),
    "context": ("persona", "personas", "name"),
}
