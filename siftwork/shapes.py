"""What may cross the wire, as closed shapes."""

from siftwork import schema
from siftwork.operators.shape import array, by_kind, closed, flag, integer, nullable, number, opt, text, tuple_of, word

# ---- fixed values: names of fields, words and limits of the wire format ---------------------------------------------
RECT = tuple_of(number(), 4)
PAGE = closed(origin_class=word("internal", "external", "benchmark"), url_template=text(), title_raw=text(), type_hint=word("form", "list", "detail", "auth", "checkout", "search", "other"), modal_active=flag(), stability=word("stable", "timeout"))
VIEWPORT = closed(w=number(), h=number(), scroll_y_pct=number(), doc_h_ratio=number(), dpr=number())
ELEMENT = closed(
    id=text(), id_hash=text(), tag=text(), role=text(), type=opt(text()), label_raw=text(), placeholder_raw=opt(text()), rect=RECT, visible=flag(), enabled=flag(), focusable=flag(), value_state=word("empty", "partial", "filled", "n/a"), options_count=opt(number()), group=text(),
    frame=number(), unexplained=opt(flag()), autocomplete=opt(text()), input_type=opt(text()), available_actions=opt(array(text())), sensitivity_class=opt(text()),
)
TEXT_NODE = closed(id=text(), rect=RECT, text=text(), owner_element_id=nullable(text()), source=word("dom"))
FRAME = closed(id=number(), origin=word("same", "cross"), rect=RECT)
HANDLE = closed(handle=text(), type=text(), tier=number(), occurrences=number(), first_seen_step=number())
BUDGET = closed(steps_left=number(), ms_left=number())
OBSERVATION = closed(observation_id=text(), session_id=text(), step=number(), page=PAGE, viewport=VIEWPORT, elements=array(ELEMENT), text_nodes=array(TEXT_NODE), frames=array(FRAME), truncated=flag(), list_virtualized=flag(), handles=opt(array(HANDLE)), budget=opt(BUDGET))
TARGET = closed(id=text(), id_hash=text())
VALUE = by_kind("kind", literal=closed(text=text(most=200)), vault_ref=closed(handle=text()), user_input=closed(field_type=text()))
ACTION = by_kind(
    "type",
    CLICK=closed(target=TARGET), TYPE=closed(target=TARGET, value=VALUE, clear_first=opt(flag())), SCROLL=closed(direction=word("down", "up", "left", "right"), amount=opt(number()), target=opt(TARGET)), SELECT=closed(target=TARGET, option_index=number()), PRESS_KEY=closed(key=text(), target=opt(TARGET)),
    NAVIGATE=closed(url_template=text()), WAIT=closed(condition=word("stable", "element", "navigation"), target=opt(TARGET), timeout_ms=opt(number())), BACK=closed(), DONE=closed(outcome=word("success", "blocked", "impossible"), evidence_element=opt(text())),
)
ENVELOPE = closed(action=ACTION, observation_id=text(), step_index=number(), session_id=text(), risk=word("low", "medium", "high"), requires_confirmation=opt(flag()), reasoning=opt(text()))
PICTURE = closed(__redactedImageBrand=word("__redactedImageBrand"), mime=word("image/png"), data_base64=text(), width=integer(exclusiveMinimum=0), height=integer(exclusiveMinimum=0), redaction_count=integer(minimum=0))
SESSION_REQUEST = closed(task=text(1, 2000), policy_profile=word(*schema.PROFILES), site_allowlist=opt(array(text(), 20)), client=opt(closed(extension_version=text(), capability=opt(closed(webgpu=flag(), wasm=flag())))))
STEP_REQUEST = closed(session_id=text(), observation=OBSERVATION, history=opt(array(ENVELOPE, 5)), last_result=opt(closed(ok=flag(), error_code=opt(text()), effect_observed=flag())), screenshot=opt(PICTURE))
STEP_RESPONSE = closed(action_envelope=ENVELOPE, provider=text(), latency_ms=number())
SESSION_RESPONSE = closed(session_id=text(), budget=BUDGET, provider=text())
HEALTH_RESPONSE = closed(status=word("ok"), providers=array(closed(name=text(), available=flag(), vision=flag(), detail=opt(text()))), active=text())
ACTION_RESULT = closed(
    ok=flag(), effect_observed=flag(), error_message=opt(text()),
    error_code=opt(word("NONE", "STALE_OBSERVATION", "IDENTITY_MISMATCH", "ELEMENT_NOT_FOUND", "ELEMENT_OBSCURED", "ELEMENT_DISABLED", "ELEMENT_NOT_FOCUSABLE", "NAVIGATION_FAILED", "EFFECT_NOT_OBSERVED", "VAULT_TYPE_MISMATCH", "LITERAL_CONTAINS_SECRET", "EGRESS_GATE_VIOLATION", "AGENT_ERROR", "ABORTED", "UNKNOWN_TARGET", "ELEMENT_NOT_ACTIONABLE", "UNSUPPORTED_ACTION", "ORIGIN_NOT_ALLOWED")),
)
# ---------------------------------------------------------------------------------------------------------------------
#: By the name under which each is exported.
ALL = {
    "SanitizedObservation": OBSERVATION, "ObservedElement": ELEMENT, "Action": ACTION, "ActionEnvelope": ENVELOPE, "Target": TARGET, "Value": VALUE, "ActionResult": ACTION_RESULT, "SessionRequest": SESSION_REQUEST, "StepRequest": STEP_REQUEST, "StepResponse": STEP_RESPONSE,
    "SessionResponse": SESSION_RESPONSE, "HealthResponse": HEALTH_RESPONSE,
}
#: What a path's body has to be; others take none.
BODIES = {"/v1/session": SESSION_REQUEST, "/v1/step": STEP_REQUEST}
