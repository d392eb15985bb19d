"""Column layout of the stored tables."""

FILES = (
    "path string, name string, suffix string, size bigint, category string,"
    " parent_folder string, is_template boolean, needs_ocr boolean"
)
DOCUMENTS = (
    "source_path string, file_name string, file_type string, full_text string,"
    " markdown_text string, category string, is_template boolean,"
    " pages array<struct<page_num:int,content:string,has_images:boolean,has_tables:boolean>>,"
    " metadata map<string,string>, errors array<string>"
)
CHUNKS = (
    "chunk_id string, content string, question string, answer string, chunk_type string,"
    " source_file string, page_num int, question_num int, metadata map<string,string>"
)
SESSIONS = (
    "session_id string, job_type string, difficulty string, max_questions int,"
    " personality_name string, status string, start_time timestamp, end_time timestamp,"
    " created_at timestamp, session_date date"
)
ANSWERS = (
    "id bigint, session_id string, question_id string, question_content string,"
    " question_type string, difficulty string, reference_answer string, user_answer string,"
    " is_followup boolean, parent_question_id string, answer_time timestamp, session_date date"
)
EVALUATIONS = (
    "id bigint, session_id string, question_id string, technical_accuracy double,"
    " clarity double, depth_breadth double, keyword_coverage double,"
    " keywords_hit array<string>, keywords_missed array<string>, weaknesses array<string>,"
    " suggestions array<string>, total_score double, needs_followup boolean,"
    " created_at timestamp, session_date date"
)
REPORTS = (
    "session_id string, overall_score double, avg_technical_accuracy double,"
    " avg_clarity double, avg_depth_breadth double, correct_rate double,"
    " weak_areas array<string>, strong_areas array<string>, suggestions array<string>,"
    " generated_at timestamp, session_date date"
)
