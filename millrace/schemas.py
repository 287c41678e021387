"""Schemas of records and warehouse tables. Reads use them as they are; nothing is inferred."""

from __future__ import annotations

COMMENT = "struct<id: string, author_uid: string, author_username: string, content: string, like_count: bigint, reply_to: string, created_at: string, type: string>"

POST = f"""platform string, content_raw string, content_type string, source_url string, author_uid string, author_username string, group_id string,
  collected_at timestamp_ntz, message_id bigint, post_id string, like_count bigint, comment_count bigint, share_count bigint, collect_count bigint,
  comments array<{COMMENT}>, tags array<string>, metadata map<string, string>, price double, seller_rating string, location string, listing_status string,
  image_urls array<string>, video_cover_url string"""

PARTNER = """platform string, content_raw string, content_type string, collected_at string, source_url string, author_uid string, author_username string,
  group_id string, message_id string, media_urls array<string>, metadata struct<keyword: string, has_image: boolean, has_video: boolean, message_id: string>"""

CHAT = """post_type string, message_type string, group_id string, user_id string, message_id string, time bigint,
  sender struct<nickname: string, card: string>, raw_message string,
  message array<struct<type: string, data: struct<text: string, url: string, file: string, summary: string, alt: string, name: string, qq: string>>>"""

#: Records as the platforms' parsers give them.
PARSED = {
    "weibo": "content_raw string, content_type string, source_url string, author_uid string, author_username string, weibo_id string, attitudes_count bigint, comments_count bigint, reposts_count bigint, topics array<string>, image_list array<string>, comments array<struct<id: string, author: string, text: string, like_count: bigint>>",
    "zhihu": "content_raw string, content_type string, source_url string, author_uid string, author_username string, question_id string, answer_id string, voteup_count bigint, comment_count bigint, topics array<string>, image_list array<string>, answers array<struct<answer_id: string, author_name: string, content: string, voteup_count: bigint, created_time: string, comments: array<struct<id: string, author: struct<name: string>, content: string, vote_count: bigint, created_time: string>>>>",
    "tieba": "content_raw string, content_type string, source_url string, author_uid string, author_username string, thread_id string, bar_name string, like_num bigint, reply_count bigint, forum_id string, image_list array<string>, replies array<struct<author_username: string, author_uid: string, content: string, reply_time: string>>",
    "xiaohongshu": "content_raw string, content_type string, source_url string, author_uid string, author_username string, note_id string, like_count bigint, comment_count bigint, collect_count bigint, tags array<string>, image_list array<string>, xsec_token string",
    "douyin": "content_raw string, content_type string, source_url string, author_uid string, author_username string, aweme_id string, like_count bigint, comment_count bigint, share_count bigint, play_count bigint, duration bigint, hashtags array<string>, image_list array<string>, video_cover_url string",
    "xianyu": "content_raw string, content_type string, source_url string, author_uid string, author_username string, item_id string, keyword string, like_count bigint, comment_count bigint, price double, seller_rating string, location string, listing_status string, image_list array<string>",
    "im": "platform string, content_raw string, content_type string, sender_uid string, sender_nickname string, group_id string, group_name string, message_id string, reply_to_id string, image_urls array<string>",
}

WAREHOUSE = {
    "ods_raw_intel": "id bigint, source_platform string, source_channel string, source_url string, source_keyword string, author_id string, author_name string, publish_time timestamp_ntz, collect_time timestamp_ntz, content_type string, content_raw string, media_urls array<string>, media_hash string, crawl_batch_id string, raw_status string, metadata map<string, string>",
    "dwd_clean_intel": "id bigint, raw_id bigint, clean_text string, merged_text string, simhash bigint, content_md5 string, dedup_group_id bigint, is_duplicate boolean, noise_score decimal(5,4), priority string, clean_status string, clean_reason string, created_at timestamp_ntz",
    "dwd_intel_analysis": "id bigint, raw_id bigint, risk_label string, risk_sub_label string, risk_score decimal(5,4), risk_level string, classification_method string, evidence_spans array<struct<start: int, end: int, evidence: string, risk: string>>, similar_intel_ids array<bigint>, analysis_status string, version int, is_latest int, created_at timestamp_ntz",
    "dwd_entity": "id bigint, raw_id bigint, entity_type string, entity_value string, normalized_value string, extract_method string, confidence decimal(5,4), context string, start_offset int, end_offset int, first_seen timestamp_ntz",
    "dwd_entity_relation": "src_entity_id bigint, dst_entity_id bigint, relation_type string, relation_source string, evidence_raw_id bigint, confidence decimal(5,4)",
    "dim_slang_dict": "term string, normalized_meaning string, risk_category string, examples array<string>, source string, confidence decimal(5,4), status string, reviewed_by string, updated_at timestamp_ntz",
    "ads_risk_case": "case_id string, main_risk_type string, risk_level string, summary string, key_entities array<string>, related_intel_count bigint, first_seen timestamp_ntz, last_seen timestamp_ntz, status string",
    "agent_report": "raw_id bigint, case_id string, report_type string, title string, summary string, disposal_advice array<string>",
    "annotation_log": "annotation_id bigint, target_type string, target_id bigint, field_name string, old_value string, new_value string, annotator string, reason string, annotated_at bigint, synced int",
    "analysis_job": "job_id string, raw_id bigint, input_text string, status string, progress int, current_step string, options map<string, string>, created_at timestamp_ntz, started_at timestamp_ntz, finished_at timestamp_ntz",
}
