"""Table layouts, as DDL."""

SOURCE_FILES = "repo_id string, path string, rel_path string, language string, content string"
CHUNK = "chunk_id string, kind string, name string, start_line int, end_line int, code string, docstring string, imports array<string>"
CHUNKS = "chunk_seq bigint, repo_id string, file_path string, language string, chunk_id string, kind string, name string, start_line int, end_line int, code string, docstring string, imports array<string>"
FRAME = "struct<file_path:string,line_number:int,function:string,language:string>"
GRAPH_NODES = "repo_id string, id string, type string, language string, label string, parent_file string, external boolean"
GRAPH_EDGES = "repo_id string, src string, dst string, relationship string, internal boolean, seq bigint"
REPOSITORIES = "repo_id string, repo_path string, backend string, owner_id string, num_files int, num_chunks int, created_at double"
CHAT_HISTORY = "repo_id string, user_id string, question string, answer string, intent string, confidence_score double, timestamp double"
BUG_REPORTS = "repo_id string, user_id string, error_report string, error_type string, top_candidate struct<file_path:string,name:string,start_line:int,score:double>, created_at double"
PATCHES = (
    "patch_id string, repo_id string, target_file string, original_code string, suggested_patch string, snippet_patch string, git_diff string, explanation string, "
    "confidence_score double, localization_confidence double, syntax_valid boolean, syntax_error string, git_apply_valid boolean, has_changes boolean, llm_generated boolean, error_type string, status string, created_at double"
)
#: What a patch may become; failed ones are never stored.
PATCH_STATUS = ("pending", "approved", "rejected", "applied", "failed")
