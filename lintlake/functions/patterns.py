"""Patterns and word lists of the extractors.

Fixed values: everything in this module is specification, so that results agree; it is data, not code.
"""

from lintlake.functions.text import Pattern as P

ENDPOINTS = [
    P("rest_api_path", r"/api(?:-[a-zA-Z]+)?/[a-zA-Z0-9_\-/{}:]+"),
    P("express_style_param", r"/[a-zA-Z]+/:[a-zA-Z]+"),
    P("openapi_style_param", r"/[a-zA-Z]+/\{[a-zA-Z]+\}"),
    P("fetch_call", r"fetch\s*\(\s*['\"`]([^'\"`]+)", 1),
    P("axios_call", r"axios\.(?:get|post|put|patch|delete)\s*\(\s*['\"`]([^'\"`]+)", 1),
    P("jquery_ajax", r"\.ajax\s*\(\s*\{[^}]*url\s*:\s*['\"`]([^'\"`]+)", 1),
    P("jquery_get_post", r"\$\.(?:get|post)\s*\(\s*['\"`]([^'\"`]+)", 1),
    P("axios_shorthand", r"axios\s*\(\s*['\"`]([^'\"`]+)", 1),
    P("axios_config_object", r"axios\s*\(\s*\{[^}]*url\s*:\s*['\"`]([^'\"`]+)", 1),
    P("xhr_open", r"\.open\s*\(\s*['\"`](?:GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)['\"`]\s*,\s*['\"`]([^'\"`]+)", 1),
    P("send_beacon", r"sendBeacon\s*\(\s*['\"`]([^'\"`]+)", 1),
    P("graphql_endpoint", r"/(?:api/)?graphql[a-zA-Z0-9_\-/]*"),
    P("websocket_url", r"wss?://[a-zA-Z0-9.\-]+(?::\d+)?[a-zA-Z0-9_\-/]*"),
]
FRAMEWORKS = [
    P("react", r"React\.createElement|__REACT_DEVTOOLS|REACT_APP_|react-dom"),
    P("angular", r"angular\.module|ng-app|@angular/core|zone\.js"),
    P("vue", r"__VUE__|Vue\.component|createApp\("),
    P("nextjs", r"__NEXT_DATA__|_next/static|NEXT_PUBLIC_"),
    P("nuxt", r"__NUXT__|\$nuxt"),
]
DOM_SINKS = [
    P("document_write", r"document\.write\s*\("),
    P("inner_html", r"\.innerHTML\s*="),
    P("outer_html", r"\.outerHTML\s*="),
    P("eval_call", r"\beval\s*\("),
    P("settimeout_string", r"setTimeout\s*\(\s*['\"`]"),
    P("setinterval_string", r"setInterval\s*\(\s*['\"`]"),
    P("function_ctor", r"\bFunction\s*\("),
    P("location_href_assign", r"location\.href\s*="),
    P("location_assign", r"location\.assign\s*\("),
    P("location_replace", r"location\.replace\s*\("),
    P("window_open", r"window\.open\s*\("),
    P("document_cookie_write", r"document\.cookie\s*="),
    P("lodash_merge", r"_\.\s*merge\s*\("),
    P("lodash_merge_with", r"_\.\s*mergeWith\s*\("),
    P("lodash_defaults_deep", r"_\.\s*defaultsDeep\s*\("),
    P("lodash_zip_object_deep", r"_\.\s*zipObjectDeep\s*\("),
    P("lodash_set", r"_\.\s*set\s*\("),
    P("jquery_extend_deep", r"\$\.extend\s*\(\s*true\s*,"),
    P("deepmerge_call", r"\bdeepmerge\s*\("),
    P("merge_deep_call", r"\bmergeDeep\s*\("),
]
DOM_SOURCES = [
    P("location_hash", r"location\.hash"),
    P("location_search", r"location\.search"),
    P("location_href_read", r"location\.href"),
    P("document_referrer", r"document\.referrer"),
    P("window_name", r"window\.name"),
    P("document_cookie_read", r"document\.cookie"),
    P("post_message_data", r"(?:event|evt|e)\.data\b"),
    P("local_storage_read", r"localStorage\.getItem"),
    P("session_storage_read", r"sessionStorage\.getItem"),
]
TAINT_SOURCES = [
    P("location.search", r"\blocation\s*\.\s*search\b"),
    P("location.hash", r"\blocation\s*\.\s*hash\b"),
    P("location.href", r"\blocation\s*\.\s*href\b"),
    P("document.URL", r"\bdocument\s*\.\s*URL\b"),
    P("document.referrer", r"\bdocument\s*\.\s*referrer\b"),
    P("window.name", r"\bwindow\s*\.\s*name\b"),
    P("event.data", r"\bevent\s*\.\s*data\b"),
    P("document.cookie", r"\bdocument\s*\.\s*cookie\b"),
    P("URLSearchParams", r"\bnew\s+URLSearchParams\s*\("),
    P("localStorage.getItem", r"\blocalStorage\s*\.\s*getItem\s*\("),
]
TAINT_SINKS = [
    P("innerHTML", r"\.\s*innerHTML\s*[+]?=(?!=)"),
    P("outerHTML", r"\.\s*outerHTML\s*[+]?=(?!=)"),
    P("document.write", r"\bdocument\s*\.\s*write\s*\("),
    P("insertAdjacentHTML", r"\.\s*insertAdjacentHTML\s*\("),
    P("eval", r"\beval\s*\("),
    P("Function", r"\bnew\s+Function\s*\("),
    P("setTimeout_str", r"\bsetTimeout\s*\(\s*['\"`]"),
    P("setInterval_str", r"\bsetInterval\s*\(\s*['\"`]"),
    P("location.href_assign", r"\blocation\s*\.\s*href\s*=(?!=)"),
    P("location.assign", r"\blocation\s*\.\s*assign\s*\("),
    P("location.replace", r"\blocation\s*\.\s*replace\s*\("),
    P("src_assign", r"\bsrc\s*=(?!=)\s*(?!['\"](?:/|\./|https?://[a-z]))"),
]
TAINT_CATEGORY = {
    "innerHTML": "xss", "outerHTML": "xss", "document.write": "xss", "insertAdjacentHTML": "xss", "eval": "code_exec", "Function": "code_exec",
    "setTimeout_str": "code_exec", "setInterval_str": "code_exec", "location.href_assign": "open_redirect", "location.assign": "open_redirect",
    "location.replace": "open_redirect", "src_assign": "script_injection",
}
TAINT_REACH = 35
ASSIGNED = P("assigned", r"(?:const|let|var)\s+([a-zA-Z_$][\w$]*)\s*=", 1)

DECLARED = P("declared", r"(?:const|let|var)\s+([a-zA-Z_$][a-zA-Z0-9_$]*)\s*=", 1)
QUERIED = P("queried", r"[?&]([a-zA-Z_][a-zA-Z0-9_\-]*)=", 1)
FUNCTION_NAME = r"(?:function\s+([a-zA-Z_$][a-zA-Z0-9_$]*)\s*\(|(?:const|let|var)\s+([a-zA-Z_$][a-zA-Z0-9_$]*)\s*=\s*(?:async\s*)?\()"
FUNCTION_REACH = 50
PARAMETER_WORDS = [
    "id", "token", "role", "admin", "redirect", "auth", "user", "session", "key", "secret", "permission", "access", "scope", "grant", "url", "uri",
    "webhook", "callback", "proxy", "endpoint", "host",
]

SYMBOLS = [
    P("global", r"\bwindow\.([A-Za-z_$][A-Za-z0-9_$]*)\s*=", 1),
    P("global", r"\bglobalThis\.([A-Za-z_$][A-Za-z0-9_$]*)\s*=", 1),
    P("export", r"\bexport\s+(?:default\s+)?(?:function|class|const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)", 1),
    P("export", r"\bexport\s*\{([^}]+)\}", 1),
    P("module", r"\bmodule\.exports\s*=\s*([A-Za-z_$][A-Za-z0-9_$]*)", 1),
    P("function", r"^(?:async\s+)?function\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*\(", 1, "m"),
    P("const", r"^const\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*=", 1, "m"),
    P("let", r"^let\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*=", 1, "m"),
    P("var", r"^var\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*=", 1, "m"),
]
NAME = r"[A-Za-z_$][A-Za-z0-9_$]*"

LINE_COMMENT = P("line", r"//(.+)", 1)
BLOCK_COMMENT = P("block", r"/\*(.*?)\*/", 1, "s")
COMMENT_WORDS = [
    "todo", "fixme", "hack", "xxx", "admin", "bypass", "auth", "password", "credential", "internal", "debug", "staging", "remove", "disable", "secret",
    "token", "hardcoded", "do not commit", "remove before", "test key", "private", "backdoor", "disabled check",
]
FLAGS = [
    P("featureFlags", r"\bfeatureFlags\b"),
    P("isEnabled", r"\bfeatures\.isEnabled\s*\("),
    P("FEATURE_", r"\bFEATURE_[A-Z0-9_]+"),
    P("window.flags", r"\bwindow\.flags\b"),
    P("config.features", r"\bconfig\.features\b"),
    P("LaunchDarkly", r"\bLaunchDarkly\b"),
    P("Optimizely", r"\bOptimizely\b", 0, "i"),
    P("splitio", r"\bsplitio\b", 0, "i"),
    P("unleash", r"\bunleash\b", 0, "i"),
    P("flagsmith", r"\bflagsmith\b", 0, "i"),
    P("growthbook", r"\bgrowthbook\b", 0, "i"),
]
FLAG_KEY = r"(?:featureFlags|isEnabled|FEATURE_|flags)\s*[\[.('\"]+\s*([A-Za-z0-9_.\-]+)"
FLAG_VALUE = r"(?:true|false|['\"]\w+['\"]|\d+)"
FLAG_SNIPPET = 120

GQL_ENDPOINT = r"(?i)(?:uri|endpoint|url)\s*[:=]\s*['\"]((?:https?://[^'\"]+)?/graphql[^'\"]*)['\"]\s*"
GQL_ENDPOINT_FETCH = r"(?i)fetch\s*\(\s*['\"]((?:https?://[^'\"]+)?/graphql[^'\"]*)['\"]\s*"
GQL_TEMPLATE = P("template", r"(?:gql|graphql)\s*`(.*?)`", 1, "s")
GQL_OPERATION = P("operation", r"(?:query|mutation|subscription)\s+([A-Za-z_][A-Za-z0-9_]*)\s*(?:\([^)]*\))?\s*\{", 1, "s")
GQL_PERSISTED = P("persisted", r"(?:operationId|queryId|persistedQuery|sha256Hash)\s*[:=]\s*['\"](?:sha256:)?([0-9a-f]{64})['\"]\s*", 1, "i")
GQL_VARIABLE = r"\$([A-Za-z_][A-Za-z0-9_]*)\s*:"
GQL_FIELD = r"\b([a-z][A-Za-z0-9_]*)\s*(?:\([^)]*\))?\s*\{"
GQL_CLIENTS = [
    P("apollo", r"\bapolloClient\b|\bApolloClient\b|\bnew ApolloClient\b"),
    P("create_client", r"\bcreateClient\b.*graphql|graphql.*\bcreateClient\b", 0, "i"),
    P("urql", r"\burql\b|\bcreateClient\b.*urql|from ['\"]urql['\"]"),
    P("graphql_request", r"\bgraphql-request\b|from ['\"]graphql-request['\"]"),
    P("relay", r"\bRelayEnvironment\b|\bRelayNetworkLayer\b"),
    P("template", r"\bgql`|graphql`"),
]
GQL_SENSITIVE_OPERATIONS = [
    "admin", "delete", "remove", "destroy", "transfer", "refund", "approve", "reject", "ban", "unban", "promote", "demote", "impersonate", "revoke",
    "purge", "reset", "grant", "elevate",
]
GQL_OWNER_IDS = ["userid", "accountid", "tenantid", "organizationid", "memberid"]
GQL_SENSITIVE_FIELDS = [
    "password", "secret", "token", "apikey", "privatekey", "ssn", "dob", "creditcard", "cvv", "bankaccount", "isadmin", "role", "permissions", "salary",
    "internalid",
]

WEBSOCKETS = [
    P("websocket", r"new\s+WebSocket\s*\(\s*['\"](wss?://[^'\"]+)['\"]\s*", 1, "i"),
    P("websocket", r"(?:wsUrl|socketUrl|wsEndpoint|ws_url|socket_url)\s*[:=]\s*['\"](wss?://[^'\"]+)['\"]\s*", 1, "i"),
    P("dynamic", r"new\s+WebSocket\s*\(\s*([^)'\"]{5,60})\s*\)", 1),
    P("socketio", r"io\s*\(\s*['\"](https?://[^'\"]+)['\"]\s*", 1, "i"),
    P("socketio_default", r"\bio\s*\(\s*\)"),
    P("sockjs", r"new\s+SockJS\s*\(\s*['\"](https?://[^'\"]+)['\"]\s*", 1, "i"),
    P("stomp", r"Stomp\.over\s*\(|StompClient\b", 0, "i"),
    P("graphql-ws", r"createClient\s*\(.*graphql.*ws|graphql-ws|subscriptionClient", 0, "is"),
]
WS_AUTH = r"(?i)[?&](token|auth|key|jwt|access_token|api_key)=[^&'\"]+"
WS_ACTIONS = [
    P("emit", r"\.emit\s*\(\s*['\"]([\w.\-:]+)['\"]\s*", 1),
    P("on", r"\.on\s*\(\s*['\"]([\w.\-:]+)['\"]\s*", 1),
    P("type", r"(?:type|action|event)\s*:\s*['\"]([\w.\-:]+)['\"]\s*", 1),
]
WS_MOST_ACTIONS = 30
WS_OBJECT_ID = P("object", r"\b(userId|accountId|tenantId|orgId|organizationId|memberId|invoiceId|orderId|documentId)\b", 1, "i")
WS_ORIGIN = P("origin", r"event\.origin\s*[!=]==?\s*|allowedOrigins\s*\.\s*includes\s*\(\s*event\b", 0, "i")

AUTH = [
    P("jwt_decode_no_verify", r"(?:jwt_decode|jwtDecode|decode)\s*\(\s*[^,)]+\s*\)(?!\s*,\s*\{)", 0, "i"),
    P("jwt_alg_none", r"(?:algorithms?|alg)\s*:\s*['\"]none['\"]", 0, "i"),
    P("jwt_jku_reference", r"\bjku\b\s*:\s*['\"](https?://[^'\"]+)['\"]", 0, "i"),
    P("jwt_x5u_reference", r"\bx5u\b\s*:\s*['\"](https?://[^'\"]+)['\"]", 0, "i"),
    P("jwt_kid_reference", r"\bkid\b.*:\s*['\"]([\w./\-]+)['\"]", 0, "i"),
    P("token_in_localstorage", r"localStorage\s*\.\s*setItem\s*\(\s*['\"]([^'\"]*(?:token|auth|jwt|key|refresh)[^'\"]*)['\"]\s*,", 1, "i"),
    P("token_in_sessionstorage", r"sessionStorage\s*\.\s*setItem\s*\(\s*['\"]([^'\"]*(?:token|auth|jwt|key)[^'\"]*)['\"]\s*,", 1, "i"),
    P("token_in_url", r"(?:location|window\.location)\s*\.\s*(?:href|search|hash).*(?:token|access_token|id_token)", 0, "i"),
    P("token_logged", r"console\s*\.\s*log\s*\([^)]*(?:token|auth|jwt|credential|password)[^)]*\)", 0, "i"),
    P("oauth_implicit_flow", r"response_type\s*[:=]\s*['\"]token['\"]", 0, "i"),
    P("oauth_dynamic_redirect_uri", r"redirect_uri\s*[:=+]\s*(?:window\.location|location\.href|location\.origin|[^'\"]{5,})", 0, "i"),
    P("refresh_token_in_localstorage", r"localStorage\s*\.\s*setItem\s*\(\s*['\"][^'\"]*refresh[^'\"]*['\"]\s*,", 0, "i"),
]
AUTH_FIRST_ONLY = ["oauth_implicit_flow", "oauth_dynamic_redirect_uri"]
AUTH_SEVERITY = {
    "jwt_decode_no_verify": "medium", "jwt_alg_none": "critical", "jwt_jku_reference": "high", "jwt_x5u_reference": "high", "jwt_kid_reference": "medium",
    "token_in_localstorage": "medium", "token_in_sessionstorage": "low", "token_in_url": "medium", "token_logged": "medium",
    "oauth_implicit_flow": "medium", "oauth_dynamic_redirect_uri": "high", "oauth_missing_state": "medium", "oauth_missing_pkce": "low",
    "refresh_token_in_localstorage": "high",
}
OAUTH_ENDPOINT = P("oauth", r"['\"]([^'\"]+(?:authorize|oauth|auth|token|callback)[^'\"]*)['\"]\s*", 0, "i")
PKCE = P("pkce", r"\bcode_verifier\b|\bcode_challenge\b|\bPKCE\b", 0, "i")
STATE = P("state", r"\bstate\b", 0, "i")

PROTO = [
    (1, P("proto_bracket_write", r"__proto__\s*\[")),
    (1, P("proto_dot_write", r"__proto__\s*\.\s*\w+\s*=(?!=)", sql=r"__proto__\s*\.\s*\w+\s*=(?:[^=]|$)")),
    (1, P("proto_object_assign", r"__proto__\s*=\s*\{")),
    (2, P("ctor_prototype_write", r"\.constructor\.prototype\s*\.\s*\w+\s*=(?!=)", sql=r"\.constructor\.prototype\s*\.\s*\w+\s*=(?:[^=]|$)")),
    (2, P("ctor_prototype_bracket", r"\.constructor\.prototype\s*\[")),
    (3, P("lodash_merge", r"\b_\.merge\s*\(")),
    (3, P("lodash_defaultsDeep", r"\b_\.defaultsDeep\s*\(")),
    (3, P("jquery_extend_deep", r"\bjQuery\.extend\s*\(\s*true")),
    (3, P("jquery_extend_deep_$", r"\$\.extend\s*\(\s*true")),
    (3, P("custom_deepMerge", r"\bdeepMerge\s*\(")),
    (3, P("custom_mergeDeep", r"\bmergeDeep\s*\(")),
    (3, P("custom_deepExtend", r"\bdeepExtend\s*\(")),
    (3, P("custom_recursiveMerge", r"\brecursiveMerge\s*\(")),
    (3, P("Object.assign_untrusted", r"\bObject\.assign\s*\(\s*(?:\w+|this)\s*,\s*(?:req\.|body|params|query|data)")),
    (4, P("dynamic_key_write", r"(?:obj|target|result|dest|base|config|options|settings)\s*\[\s*(?:key|prop|name|attr|k)\s*\]\s*=(?!=)", sql=r"(?:obj|target|result|dest|base|config|options|settings)\s*\[\s*(?:key|prop|name|attr|k)\s*\]\s*=(?:[^=]|$)")),
    (4, P("for_in_copy", r"(?:for\s*\([^)]+\s+in\s+[^)]+\))\s*\{[^}]*\[\s*\w+\s*\]\s*=(?!=)", sql=r"(?:for\s*\([^)]+\s+in\s+[^)]+\))\s*\{[^}]*\[\s*\w+\s*\]\s*=(?:[^=]|$)")),
    (5, P("Object.prototype_write", r"Object\.prototype\s*\.\s*[a-zA-Z_$][\w$]*\s*=(?!=)", sql=r"Object\.prototype\s*\.\s*[a-zA-Z_$][\w$]*\s*=(?:[^=]|$)")),
    (5, P("Object.prototype_bracket_write", r"Object\.prototype\s*\[['\"]\w+['\"]\]\s*=(?!=)", sql=r"Object\.prototype\s*\[['\"]\w+['\"]\]\s*=(?:[^=]|$)")),
]
GADGETS = [
    P("innerHTML_gadget", r"\.innerHTML\s*=(?!=)", sql=r"\.innerHTML\s*=(?:[^=]|$)"),
    P("eval_gadget", r"\beval\s*\("),
    P("template_gadget", r"(?:template|tmpl|render)\s*\("),
    P("isAdmin_gadget", r"\bisAdmin\b"),
    P("role_gadget", r"\brole\b"),
    P("permissions_gadget", r"\bpermissions\b"),
    P("Function_gadget", r"\bnew\s+Function\s*\("),
]

# the repeated group is possessive here: its branches start with different characters and none takes the comma
POST_SEND = P(
    "sender",
    r"\.postMessage\s*\(\s*(?:[^()'\"`{},]++|(?:'[^']*'|\"[^\"]*\"|`[^`]*`)|(?:\{[^{}]*\}))*+,\s*(['\"`][^'\"`]*?['\"`]|\w[\w.]*)\s*\)", 1, "i",
    r"\.postMessage\s*\(\s*(?:[^()'\"`{},]|(?:'[^']*'|\"[^\"]*\"|`[^`]*`)|(?:\{[^{}]*\}))*,\s*(['\"`][^'\"`]*?['\"`]|\w[\w.]*)\s*\)",
)
POST_LISTEN = P("receiver", r"addEventListener\s*\(\s*['\"]message['\"]\s*,", 0, "i")
POST_ORIGIN = P(
    "origin",
    r"event\s*\.\s*origin\s*(?:!==|===|==|!=|<|>)\s*['\"`]|(?:allowedOrigins?|trustedOrigins?|whitelist|ALLOWED_ORIGINS)\s*\.(?:includes?|has|indexOf)\s*\(\s*event|event\s*\.\s*origin\s+(?:in|===)\s+\w",
    0, "i",
)
POST_SINKS = [
    P("eval", r"\beval\s*\(\s*event\s*\.\s*data"),
    P("innerHTML", r"\.innerHTML\s*=\s*.*?event\s*\.\s*data"),
    P("location", r"(?:location\s*\.?\s*href|location\.assign|location\.replace)\s*.*?event\s*\.\s*data"),
    P("JSON.parse", r"JSON\s*\.\s*parse\s*\(\s*event\s*\.\s*data"),
    P("document.write", r"document\s*\.\s*write\s*\(\s*event\s*\.\s*data"),
    P("Function", r"(?:new\s+Function|Function\.prototype\.call)\s*\(\s*event\s*\.\s*data"),
]
POST_REACH = 25

WORKERS = [
    P("service_worker", r"navigator\s*\.\s*serviceWorker\s*\.\s*register\s*\(\s*['\"`]([^'\"`]+)['\"`]", 1, "i"),
    P("service_worker_dynamic", r"navigator\s*\.\s*serviceWorker\s*\.\s*register\s*\((?!\s*['\"`][^'\"`]+['\"`])", 0, "i", r"navigator\s*\.\s*serviceWorker\s*\.\s*register\s*\(\s*[^'\"`\s]"),
    P("blob_worker", r"\bnew\s+Worker\s*\(\s*URL\s*\.\s*createObjectURL", 0, "i"),
    P("web_worker", r"\bnew\s+Worker\s*\(\s*['\"`]([^'\"`]+)['\"`]", 1, "i"),
    P("shared_worker", r"\bnew\s+SharedWorker\s*\(\s*['\"`]([^'\"`]+)['\"`]", 1, "i"),
]
WORKER_FETCH = P("fetch", r"self\s*\.\s*addEventListener\s*\(\s*['\"]fetch['\"]", 0, "i")
WORKER_SKIP = P("skip", r"\bself\s*\.\s*skipWaiting\s*\(|\bskipWaiting\s*\(", 0, "i")
WORKER_CLAIM = P("claim", r"\bclients\s*\.\s*claim\s*\(", 0, "i")
IMPORT_SCRIPTS = P("import", r"\bimportScripts\s*\(([^)]+)\)", 1, "i")
QUOTED_URL = r"['\"`]([^'\"`]+)['\"`]"

LIBRARIES = {
    "jquery": (r"jQuery\s+v?(\d+\.\d+[\.\d]*)", ["1.", "2.", "3.0", "3.1", "3.2", "3.3", "3.4", "3.5"]),
    "lodash": (r"lodash\s+v?(\d+\.\d+[\.\d]*)", ["4.0", "4.1", "4.2", "4.3", "4.4", "4.5", "4.6", "4.7"]),
    "angular": (r"AngularJS\s+v?(\d+\.\d+[\.\d]*)", ["1."]),
    "moment": (r"moment\.js\s+v?(\d+\.\d+[\.\d]*)", [""]),
    "bootstrap": (r"Bootstrap\s+v?(\d+\.\d+[\.\d]*)", ["2.", "3."]),
}

LINK = P("html_link", r"<a[^>]+href=[\"']([^\"'#][^\"']*)[\"']", 1, "i")
FORM = P("form", r"<form\b[^>]*>", 0, "i")
FORM_ACTION = r"(?i)\baction=[\"']([^\"']*)[\"']"
FORM_METHOD = r"(?i)\bmethod=[\"']([^\"']*)[\"']"
SKIPPED_SCHEMES = ["javascript:", "mailto:", "tel:"]
SCRIPT_SRC = P("script", r"<script[^>]+src=[\"']([^\"']+)[\"']", 1, "i")
SCRIPT = P("inline", r"<script([^>]*)>(.*?)</script>", 2, "is")
SCRIPT_ATTRIBUTES = P("attributes", r"<script([^>]*)>(.*?)</script>", 1, "is")
SCRIPT_HAS_SRC = r"(?i)\bsrc\s*="
SCRIPT_TYPE = r"(?i)\btype\s*=\s*['\"]([^'\"]+)['\"]"
SCRIPT_TYPES = ["text/javascript", "application/javascript", "module"]
SHORTEST_SCRIPT = 20
SOURCE_MAP = r"//[#@]\s*sourceMappingURL=(\S+)"
JS_URL = r"(?i)\.js(?:[?#]|$)"
ASSET_URL = r"(?i)\.(?:css|png|jpe?g|gif|svg|ico|webp|woff2?|ttf|eot|otf|mp4|mp3|pdf|zip|map)(?:[?#]|$)"
LABEL = r"[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"

ENV_DEV = r"(?i)(?:^|\.)(?:dev|develop|development|local|localhost|127\.0\.0\.1)"
ENV_STAGING = r"(?i)(?:^|\.)(?:staging|stage|stg|uat|sit|preprod|pre-prod|preview|test|qa|sandbox|dev|develop|development|local|localhost)"
API_GROUPS = {
    "auth": "login logout register token oauth sso session password reset signin signup verify confirm mfa 2fa".split(),
    "user": "user account profile me member subscriber identity person".split(),
    "admin": "admin staff internal manage console superuser moderator backstage dashboard panel control".split(),
    "billing": "pay billing invoice subscription checkout stripe plan pricing charge refund wallet payment".split(),
    "search": "search query find suggest autocomplete lookup filter sort".split(),
    "debug": "debug test health ping status metrics monitor diag trace log echo".split(),
    "upload": "upload file attachment media image document asset storage".split(),
    "notification": "notification alert email sms push message inbox webhook".split(),
}
CROSS_TENANT = ["tenantid", "tenant_id", "orgid", "org_id", "organizationid", "organization_id", "accountid", "account_id"]
SENSITIVE_PROPERTY = P(
    "property",
    r"\b(role|isAdmin|is_admin|isOwner|is_owner|permissions|admin|staff|superuser|approvalStatus|approval_status|verified|isVerified|is_verified|balance|creditLimit|credit_limit|plan|subscription|tier|status|accountStatus|account_status)\b",
    1, "i",
)
SPREADS = [
    P("spread", r"\{\s*\.\.\.\s*\w+\s*,\s*\.\.\.\w+"),
    P("assign", r"Object\.assign\s*\(\s*\{\s*\}"),
    P("body", r"(?:body|data|payload)\s*[:=]\s*\{\s*\.\.\."),
    P("form", r"(?:formData|form_data|userData)\s*\[['\"](\w+)['\"]\]\s*="),
]
PRIVILEGED = r"(?i)/(?:admin|internal|staff|moderator|superuser|backstage|manage|console)"
PATH_IDENTIFIER = r"/:([a-zA-Z_][a-zA-Z0-9_]*)|\{([a-zA-Z_][a-zA-Z0-9_]*)\}"
QUERY_IDENTIFIER = r"[?&]([a-zA-Z_][a-zA-Z0-9_]*)=(?:\d+|[0-9a-f-]{8,})\b"
NUMERIC_PATH = r"/\d{3,}"
PLACEHOLDER_PATH = r"/:[a-zA-Z_][a-zA-Z0-9_]*|\{[a-zA-Z_][a-zA-Z0-9_]*\}"
BUNDLERS = {
    "webpack": [r"\b__webpack_require__\b", r"\bwebpackChunk[A-Za-z_$]", r"\bwebpackJsonp\b", r"webpackChunkName\s*:"],
    "vite": [r"\b_?_vitePreload\b", r"\b__vite__mapDeps\b", r"/@vite/"],
    "next": [r"\b__NEXT_DATA__\b", r"/_next/static/", r"\bnextChunksUrl\b", r"\bbuildManifest\b"],
}
CHUNK_NAME = r"(?i)/\*\s*webpackChunkName\s*:\s*['\"`]([^'\"`]+)['\"`]\s*\*/"
DYNAMIC_IMPORT = P("dynamic", r"import\s*\(\s*(?:/\*[^*]*\*/\s*)?['\"`]([^'\"`]+)['\"`]\s*\)", 1)
STATIC_IMPORT = P("static", r"(?:^|;)\s*import\s+(?:[^'\"`;]*)?\s*from\s+['\"`]([^'\"`]+)['\"`]", 1, "m")
NEXT_CHUNK = P("next", r"/_next/static/chunks/([^'\")\s,]+\.js)", 1)
VITE_PRELOAD = P("preload", r"(?:_?_vitePreload|__vite__mapDeps)\s*\(\s*(?:\(\s*\)\s*=>\s*)?import\s*\(\s*['\"`]([^'\"`]+)['\"`]", 1)
REQUIRE_ENSURE = P("ensure", r"require\.ensure\s*\(\s*\[([^\]]*)\]", 1, "i")

SENSITIVE_FIELDS = ["email", "phone", "ssn", "address", "token", "password", "name", "dob", "secret"]
INJECTIONS = [
    r"ignore\s+(all\s+|any\s+)?(previous|prior|above)\s+instructions", r"\byou are now\b", r"\bsystem prompt\b", r"\bnew instructions?\b",
    r"disregard\s+(all\s+|any\s+)?(previous|prior)",
]
UNSAFE_WORDS = ["drop table", "brute force", "brute-force", "default password", "sql injection payload", "rm -rf", "delete from", " fuzz"]
PLAINTEXT_KEYS = r"(?i)AKIA[0-9A-Z]{16}|sk_live_[0-9A-Za-z]{24,}|gh[pousr]_[0-9A-Za-z]{36,}"
INTEREST_WEIGHTS = {"secrets": 10, "entropy": 3, "object_access": 8, "auth": 5, "dom": 6, "proto": 7, "graphql": 4, "parameters": 1}
