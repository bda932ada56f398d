"""Table and payload schemas."""

from __future__ import annotations

from .functions.labels import RESULT_TYPE

EVENT_STORE = (
    "id string, workflow_id string, execution_id string, organization_id string,"
    " created_at timestamp, event_type string, event string, anonymization_status string"
)

_FILE = (
    "struct<filename:string,s3_key:string,size:bigint,content_type:string,"
    "uploaded_at:string,presigned_url:string>"
)
_POINT = "struct<x:int,y:int>"
BARCODE = (
    f"struct<type:string,page_number:int,position:struct<top_left:{_POINT},top_right:{_POINT},"
    f"bottom_right:{_POINT},bottom_left:{_POINT}>,is_valid:boolean,raw_data:string,"
    "typed_data:string,issue_date:date,ants_type:string,doc_type:string>"
)
_RESULT = (
    "struct<classification:struct<document_type:string,explanation:string,confidence:double>,"
    f"extraction:struct<type:string,properties:string>,barcodes:array<{BARCODE}>>"
)
_STEP = (
    "struct<step_name:string,execution_time:double,request_tokens:bigint,response_tokens:bigint>"
)

# Superset of the members of the four event payloads.
EVENT_PAYLOAD = (
    f"s3_file_info {_FILE}, file_url string, metadata string,"
    " classification_parameters struct<llm_model:string,document_types:array<string>>,"
    " extraction_parameters struct<llm_model:string,document_type:string>,"
    " step_name string, step_result string, execution_time_ms bigint, output_data string,"
    f" final_result {_RESULT}, total_processing_time_ms bigint, output_summary string,"
    f" steps_completed int, workflow_metadata array<{_STEP}>,"
    " error_type string, error_message string, failed_step string, retry_count int"
)

ANNOTATION = (
    f"struct<ground_truth:boolean,completed_by:string,result:array<{RESULT_TYPE}>>"
)
PREDICTION = f"struct<id:bigint,model_version:string,result:array<{RESULT_TYPE}>>"
LABEL_TASK = (
    "id bigint, project bigint, data struct<pdf:string,document_type:string>,"
    f" annotations array<{ANNOTATION}>, predictions array<{PREDICTION}>"
)

EXPERIMENTS = (
    "id string, label_project_id bigint, metric_name string, created_at timestamp,"
    " total_tasks int, processed_count int, average_score double, model_version_stats string,"
    " status string, notes string"
)
OBSERVATIONS = (
    "experiment_id string, task_id bigint, prediction_id bigint, model_version string,"
    " score double, processing_time_ms double, metric_results string, created_at timestamp"
)
ORGANIZATIONS = (
    "id string, contact_email string, name string, platform_role string,"
    " created_at timestamp, updated_at timestamp"
)
API_KEYS = (
    "id string, organization_id string, key_hash string, prefix string, status string,"
    " created_at timestamp, updated_at timestamp"
)
WEBHOOKS = (
    "id string, organization_id string, url string, headers map<string,string>,"
    " created_at timestamp, updated_at timestamp"
)
WORKFLOWS = (
    "id string, name string, description string, version string, enabled boolean,"
    " supported_file_types array<string>, steps array<string>, llm_model string,"
    " max_file_size_mb int, processing_timeout_minutes int, created_at string,"
    " updated_at string"
)
OCR_PAGES = "pages array<struct<page_number:int,text:string,has_failed:boolean>>"
REPLAY = (
    "execution_id string, document_type string, model string, system_prompt string,"
    " user_prompt string"
)
MESSAGES = "msg_id string, data string, retries int, timestamp timestamp"
