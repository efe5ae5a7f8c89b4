"""Declared schemas of the model's relations; nothing is inferred."""

from __future__ import annotations

# Names of fields in the files that the model reads and writes. Fixed values.
PAIR = "schema_version string, id string, criterion_name string, criterion_description string, positive_hint string, negative_hint string, prompt string, response_1 string, response_2 string, correct_response int, group_id string, levels array<string>, agent_1 string, agent_2 string, context struct<domain:string,task_id:string,policy:string,task_purpose:string,user_persona:string,user_instructions:string>"
BLIND = ("id", "criterion_name", "criterion_description", "prompt", "response_1", "response_2", "schema_version", "context")
#: What a blind record keeps of the context. Fixed values.
BLIND_CONTEXT = ("domain", "task_id", "task_purpose", "user_persona")
ANSWER = ("id", "correct_response", "levels", "positive_hint", "negative_hint", "group_id")
ANSWERS = "id string, correct_response int, levels array<string>"
CALL = "model string, role string, label string, item_id string, attempt int, prompt_tokens bigint, completion_tokens bigint, reasoning_tokens bigint, reasoning_source string, content_chars bigint, reasoning_chars bigint, latency_s double, ok boolean, error string"
SCORE_CALL = f"label string, id string, key string, run int, score double, usage struct<{', '.join(f'{n}:{t}' for n, t in (c.split(' ') for c in CALL.split(', ')))}>"
#: A line of the log as ``append_log`` writes it: with the append that it belongs to and its row there.
LOGGED_CALL = f"{SCORE_CALL}, append string, row bigint"
ANNOTATION = "id string, criterion_name string, judge_preference int, confidence int"
VOTE = "id string, judge string, model string, criterion_name string, group_key string, side int, a_was int, attempts int, reasoning string"
INDEX = "key string, domain string, criterion string, task_index int, task_id string, gap array<string>, agent string, state string, phase string, pair_id string, detail string, attempt int"
RUN = "run int, score_1 double, score_2 double, higher_score int, correct boolean, error string"
RESULT = f"id string, criterion_name string, correct_response int, runs array<struct<{', '.join(f'{n}:{t}' for n, t in (c.split(' ') for c in RUN.split(', ')))}>>, pass_rate double, score_1_mean double, score_1_std double, score_2_mean double, score_2_std double"
SUMMARY = "label string, kind string, wall_s double, n_scored bigint, n_expected bigint, n_errors bigint, accuracy double, tie_rate double, error_rate double, stability string, always_tied bigint, wobbled bigint, flipped bigint, acc_kept double, acc_discarded double, n_kept bigint, n_discarded bigint, distinct_scores bigint, score_sd double, temperature double, lane string"
CRITERION = "name string, description string"
TURN = "struct<index:int,role:string,content:string,tool_calls:array<struct<id:string,name:string,arguments:string,requestor:string,extra:string>>,tool_results:array<struct<id:string,requestor:string,content:string,error:boolean,doc_ids:array<string>>>,extra:string>"
TRAJECTORY = f"trajectory_id string, key string, level string, context_key string, turns array<{TURN}>, termination_reason string, hit_max_steps boolean, duration_s double, reward double, reward_basis array<string>, reward_breakdown map<string,double>"
