"""The rule catalogue: recorded series and alert conditions of the monitored stack, one row per rule."""

from __future__ import annotations

from tidewatch.operators.recording import Alert, Operand, Rule

# Recorded series: name, operation, operands, constant.
RECORDING_RULES = (
    Rule("elasticsearch:cluster:status", "worst", (Operand("elasticsearch_cluster_health_status", match=(("color", "green"),), agg="max", by=("cluster",)), Operand("elasticsearch_cluster_health_status", match=(("color", "yellow"),), agg="max", by=("cluster",)), Operand("elasticsearch_cluster_health_status", match=(("color", "red"),), agg="max", by=("cluster",)))),
    Rule("elasticsearch:cluster:is_healthy", "a is k", (Operand("elasticsearch_cluster_health_status", match=(("color", "green"),), agg="max", by=("cluster",)),), 1),
    Rule("elasticsearch:cluster:node_count", "a", (Operand("elasticsearch_cluster_health_number_of_nodes"),)),
    Rule("elasticsearch:cluster:data_node_count", "a", (Operand("elasticsearch_cluster_health_number_of_data_nodes"),)),
    Rule("elasticsearch:shards:total", "a", (Operand("elasticsearch_cluster_health_active_shards"),)),
    Rule("elasticsearch:shards:primary", "a", (Operand("elasticsearch_cluster_health_active_primary_shards"),)),
    Rule("elasticsearch:shards:unassigned", "a", (Operand("elasticsearch_cluster_health_unassigned_shards"),)),
    Rule("elasticsearch:shards:relocating", "a", (Operand("elasticsearch_cluster_health_relocating_shards"),)),
    Rule("elasticsearch:shards:initializing", "a", (Operand("elasticsearch_cluster_health_initializing_shards"),)),
    Rule("elasticsearch:shards:delayed_unassigned", "a", (Operand("elasticsearch_cluster_health_delayed_unassigned_shards"),)),
    Rule("elasticsearch:jvm:heap_used_bytes", "a", (Operand("elasticsearch_jvm_memory_used_bytes", match=(("area", "heap"),)),)),
    Rule("elasticsearch:jvm:heap_max_bytes", "a", (Operand("elasticsearch_jvm_memory_max_bytes", match=(("area", "heap"),)),)),
    Rule("elasticsearch:jvm:heap_usage_ratio", "a/b", (Operand("elasticsearch_jvm_memory_used_bytes", match=(("area", "heap"),)), Operand("elasticsearch_jvm_memory_max_bytes", match=(("area", "heap"),)))),
    Rule("elasticsearch:jvm:nonheap_used_bytes", "a", (Operand("elasticsearch_jvm_memory_used_bytes", match=(("area", "non-heap"),)),)),
    Rule("elasticsearch:jvm:gc_count_rate:5m", "a", (Operand("elasticsearch_jvm_gc_collection_seconds_count", "rate", 300),)),
    Rule("elasticsearch:jvm:gc_time_rate:5m", "a", (Operand("elasticsearch_jvm_gc_collection_seconds_sum", "rate", 300),)),
    Rule("elasticsearch:indexing:rate:5m", "a", (Operand("elasticsearch_indices_indexing_index_total", "rate", 300, agg="sum"),)),
    Rule("elasticsearch:indexing:delete_rate:5m", "a", (Operand("elasticsearch_indices_indexing_delete_total", "rate", 300, agg="sum"),)),
    Rule("elasticsearch:bulk:rate:5m", "a", (Operand("elasticsearch_indices_bulk_total", "rate", 300, agg="sum"),)),
    Rule("elasticsearch:search:query_rate:5m", "a", (Operand("elasticsearch_indices_search_query_total", "rate", 300, agg="sum"),)),
    Rule("elasticsearch:search:fetch_rate:5m", "a", (Operand("elasticsearch_indices_search_fetch_total", "rate", 300, agg="sum"),)),
    Rule("elasticsearch:search:scroll_rate:5m", "a", (Operand("elasticsearch_indices_search_scroll_total", "rate", 300, agg="sum"),)),
    Rule("elasticsearch:indexing:rate:5m:by_node", "a", (Operand("elasticsearch_indices_indexing_index_total", "rate", 300),)),
    Rule("elasticsearch:search:query_rate:5m:by_node", "a", (Operand("elasticsearch_indices_search_query_total", "rate", 300),)),
    Rule("elasticsearch:search:scroll_current", "a", (Operand("elasticsearch_indices_search_scroll_current", agg="sum"),)),
    Rule("elasticsearch:search:query_latency_avg:5m", "a/b", (Operand("elasticsearch_indices_search_query_time_seconds_total", "rate", 300), Operand("elasticsearch_indices_search_query_total", "rate", 300))),
    Rule("elasticsearch:search:fetch_latency_avg:5m", "a/b", (Operand("elasticsearch_indices_search_fetch_time_seconds_total", "rate", 300), Operand("elasticsearch_indices_search_fetch_total", "rate", 300))),
    Rule("elasticsearch:bulk:latency_avg:5m", "a/b", (Operand("elasticsearch_indices_bulk_time_seconds_total", "rate", 300), Operand("elasticsearch_indices_bulk_total", "rate", 300))),
    Rule("elasticsearch:indexing:latency_avg:5m", "a/b", (Operand("elasticsearch_indices_indexing_index_time_seconds_total", "rate", 300), Operand("elasticsearch_indices_indexing_index_total", "rate", 300))),
    Rule("elasticsearch:disk:total_bytes", "a", (Operand("elasticsearch_filesystem_data_size_bytes"),)),
    Rule("elasticsearch:disk:free_bytes", "a", (Operand("elasticsearch_filesystem_data_free_bytes"),)),
    Rule("elasticsearch:disk:used_bytes", "a-b", (Operand("elasticsearch_filesystem_data_size_bytes"), Operand("elasticsearch_filesystem_data_free_bytes"))),
    Rule("elasticsearch:disk:usage_ratio", "1-a/b", (Operand("elasticsearch_filesystem_data_free_bytes"), Operand("elasticsearch_filesystem_data_size_bytes"))),
    Rule("elasticsearch:indices:store_size_bytes", "a", (Operand("elasticsearch_indices_store_size_bytes_total", agg="sum"),)),
    Rule("elasticsearch:indices:store_size_bytes:by_node", "a", (Operand("elasticsearch_indices_store_size_bytes_total"),)),
    Rule("elasticsearch:threadpool:queue_size", "a", (Operand("elasticsearch_thread_pool_queue_count"),)),
    Rule("elasticsearch:threadpool:active", "a", (Operand("elasticsearch_thread_pool_active_count"),)),
    Rule("elasticsearch:threadpool:rejected_total", "a", (Operand("elasticsearch_thread_pool_rejected_count"),)),
    Rule("elasticsearch:threadpool:queue_size:search", "a", (Operand("elasticsearch_thread_pool_queue_count", match=(("name", "search"),)),)),
    Rule("elasticsearch:threadpool:queue_size:write", "a", (Operand("elasticsearch_thread_pool_queue_count", match=(("name", "write"),)),)),
    Rule("elasticsearch:threadpool:queue_size:get", "a", (Operand("elasticsearch_thread_pool_queue_count", match=(("name", "get"),)),)),
    Rule("elasticsearch:threadpool:active:search", "a", (Operand("elasticsearch_thread_pool_active_count", match=(("name", "search"),)),)),
    Rule("elasticsearch:threadpool:active:write", "a", (Operand("elasticsearch_thread_pool_active_count", match=(("name", "write"),)),)),
    Rule("elasticsearch:threadpool:rejected_rate:5m", "a", (Operand("elasticsearch_thread_pool_rejected_count", "rate", 300),)),
    Rule("elasticsearch:threadpool:rejected_rate:5m:search", "a", (Operand("elasticsearch_thread_pool_rejected_count", "rate", 300, match=(("name", "search"),)),)),
    Rule("elasticsearch:threadpool:rejected_rate:5m:write", "a", (Operand("elasticsearch_thread_pool_rejected_count", "rate", 300, match=(("name", "write"),)),)),
    Rule("elasticsearch:threadpool:completed_rate:5m", "a", (Operand("elasticsearch_thread_pool_completed_count", "rate", 300),)),
    Rule("elasticsearch:threadpool:completed_rate:5m:search", "a", (Operand("elasticsearch_thread_pool_completed_count", "rate", 300, match=(("name", "search"),)),)),
    Rule("elasticsearch:threadpool:completed_rate:5m:write", "a", (Operand("elasticsearch_thread_pool_completed_count", "rate", 300, match=(("name", "write"),)),)),
    Rule("elasticsearch:breaker:estimated_bytes", "a", (Operand("elasticsearch_breakers_estimated_size_bytes"),)),
    Rule("elasticsearch:breaker:limit_bytes", "a", (Operand("elasticsearch_breakers_limit_size_bytes"),)),
    Rule("elasticsearch:breaker:usage_ratio", "a/b", (Operand("elasticsearch_breakers_estimated_size_bytes"), Operand("elasticsearch_breakers_limit_size_bytes"))),
    Rule("elasticsearch:breaker:parent:usage_ratio", "a/b", (Operand("elasticsearch_breakers_estimated_size_bytes", match=(("name", "parent"),)), Operand("elasticsearch_breakers_limit_size_bytes", match=(("name", "parent"),)))),
    Rule("elasticsearch:breaker:fielddata:usage_ratio", "a/b", (Operand("elasticsearch_breakers_estimated_size_bytes", match=(("name", "fielddata"),)), Operand("elasticsearch_breakers_limit_size_bytes", match=(("name", "fielddata"),)))),
    Rule("elasticsearch:breaker:request:usage_ratio", "a/b", (Operand("elasticsearch_breakers_estimated_size_bytes", match=(("name", "request"),)), Operand("elasticsearch_breakers_limit_size_bytes", match=(("name", "request"),)))),
    Rule("elasticsearch:breaker:tripped_rate:5m", "a", (Operand("elasticsearch_breakers_tripped", "rate", 300),)),
    Rule("elasticsearch:os:cpu_percent", "a", (Operand("elasticsearch_os_cpu_percent"),)),
    Rule("elasticsearch:os:mem_used_percent", "a", (Operand("elasticsearch_os_mem_used_percent"),)),
    Rule("elasticsearch:os:mem_free_bytes", "a", (Operand("elasticsearch_os_mem_free_bytes"),)),
    Rule("elasticsearch:os:mem_total_bytes", "a", (Operand("elasticsearch_os_mem_total_bytes"),)),
    Rule("elasticsearch:os:load_average_1m", "a", (Operand("elasticsearch_os_load1"),)),
    Rule("elasticsearch:os:load_average_5m", "a", (Operand("elasticsearch_os_load5"),)),
    Rule("elasticsearch:os:load_average_15m", "a", (Operand("elasticsearch_os_load15"),)),
    Rule("elasticsearch:process:cpu_percent", "a", (Operand("elasticsearch_process_cpu_percent"),)),
    Rule("elasticsearch:process:open_fds", "a", (Operand("elasticsearch_process_open_files_count"),)),
    Rule("elasticsearch:process:max_fds", "a", (Operand("elasticsearch_process_max_files_descriptors"),)),
    Rule("elasticsearch:process:fds_usage_ratio", "a/b", (Operand("elasticsearch_process_open_files_count"), Operand("elasticsearch_process_max_files_descriptors"))),
    Rule("elasticsearch:transport:rx_bytes_rate:5m", "a", (Operand("elasticsearch_transport_rx_bytes_total", "rate", 300),)),
    Rule("elasticsearch:transport:tx_bytes_rate:5m", "a", (Operand("elasticsearch_transport_tx_bytes_total", "rate", 300),)),
    Rule("elasticsearch:transport:rx_packets_rate:5m", "a", (Operand("elasticsearch_transport_rx_packets_total", "rate", 300),)),
    Rule("elasticsearch:transport:tx_packets_rate:5m", "a", (Operand("elasticsearch_transport_tx_packets_total", "rate", 300),)),
    Rule("elasticsearch:transport:server_open", "a", (Operand("elasticsearch_transport_server_open_total"),)),
    Rule("elasticsearch:http:current_open", "a", (Operand("elasticsearch_http_current_open"),)),
    Rule("elasticsearch:http:total_opened_rate:5m", "a", (Operand("elasticsearch_http_total_opened", "rate", 300),)),
    Rule("elasticsearch:indices:docs_count", "a", (Operand("elasticsearch_indices_docs_count", agg="sum"),)),
    Rule("elasticsearch:indices:docs_deleted", "a", (Operand("elasticsearch_indices_docs_deleted", agg="sum"),)),
    Rule("elasticsearch:segments:count", "a", (Operand("elasticsearch_indices_segments_count", agg="sum"),)),
    Rule("elasticsearch:segments:memory_bytes", "a", (Operand("elasticsearch_indices_segments_memory_bytes", agg="sum"),)),
    Rule("elasticsearch:indices:docs_count:by_index", "a", (Operand("elasticsearch_indices_docs_count"),)),
    Rule("elasticsearch:indices:merges_rate:5m", "a", (Operand("elasticsearch_indices_merges_total", "rate", 300),)),
    Rule("elasticsearch:indices:merges_docs_rate:5m", "a", (Operand("elasticsearch_indices_merges_docs_total", "rate", 300),)),
    Rule("elasticsearch:indices:refresh_rate:5m", "a", (Operand("elasticsearch_indices_refresh_total", "rate", 300),)),
    Rule("elasticsearch:indices:flush_rate:5m", "a", (Operand("elasticsearch_indices_flush_total", "rate", 300),)),
    Rule("elasticsearch:cache:query:hit_rate:5m", "a/(a+b)", (Operand("elasticsearch_indices_querycache_hits_total", "rate", 300), Operand("elasticsearch_indices_querycache_misses_total", "rate", 300))),
    Rule("elasticsearch:cache:request:hit_rate:5m", "a/(a+b)", (Operand("elasticsearch_indices_requestcache_hits_total", "rate", 300), Operand("elasticsearch_indices_requestcache_misses_total", "rate", 300))),
    Rule("elasticsearch:cache:query:memory_bytes", "a", (Operand("elasticsearch_indices_querycache_memory_size_bytes"),)),
    Rule("elasticsearch:cache:request:memory_bytes", "a", (Operand("elasticsearch_indices_requestcache_memory_size_bytes"),)),
    Rule("elasticsearch:cache:query:evictions_rate:5m", "a", (Operand("elasticsearch_indices_querycache_evictions_total", "rate", 300),)),
    Rule("elasticsearch:cache:request:evictions_rate:5m", "a", (Operand("elasticsearch_indices_requestcache_evictions_total", "rate", 300),)),
    Rule("elasticsearch:fielddata:evictions_rate:5m", "a", (Operand("elasticsearch_indices_fielddata_evictions_total", "rate", 300),)),
    Rule("elasticsearch:fielddata:memory_bytes", "a", (Operand("elasticsearch_indices_fielddata_memory_size_bytes"),)),
    Rule("probe:success_rate:5m", "a", (Operand("probe_success", "avg", 300),)),
    Rule("probe:success_rate:5m:by_job", "a", (Operand("probe_success", "avg", 300, agg="avg", by=("job", "instance")),)),
    Rule("probe:duration_avg:5m", "a", (Operand("probe_duration_seconds", "avg", 300),)),
    Rule("probe:duration_p95:5m", "quantile", (Operand("probe_duration_seconds_bucket", "rate", 300, agg="sum", by=("le", "job")),), 0.95),
    Rule("probe:ssl_cert_expiry_days", "(a-t)/86400", (Operand("probe_ssl_earliest_cert_expiry"),)),
    Rule("otel:receiver:accepted_rate:5m", "a", (Operand("otelcol_receiver_accepted_metric_points", "rate", 300, agg="sum", by=("receiver",)),)),
    Rule("otel:receiver:refused_rate:5m", "a", (Operand("otelcol_receiver_refused_metric_points", "rate", 300, agg="sum", by=("receiver",)),)),
    Rule("otel:exporter:sent_rate:5m", "a", (Operand("otelcol_exporter_sent_metric_points", "rate", 300, agg="sum", by=("exporter",)),)),
    Rule("otel:exporter:failed_rate:5m", "a", (Operand("otelcol_exporter_send_failed_metric_points", "rate", 300, agg="sum", by=("exporter",)),)),
    Rule("_otel:batch_size", "a/b", (Operand("otelcol_processor_batch_batch_send_size_sum"), Operand("otelcol_processor_batch_batch_send_size_count"))),
    Rule("otel:processor:batch_size_avg", "a", (Operand("_otel:batch_size", agg="avg", by=("processor",)),)),
    Rule("kafka:cluster:broker_count", "a", (Operand("up", match=(("job", "kafka-jmx"),), where=("==", 1), agg="count"),)),
    Rule("kafka:cluster:broker_up", "a", (Operand("up", match=(("job", "kafka-jmx"),)),)),
    Rule("kafka:cluster:active_controller_count", "a", (Operand("kafka_controller_active_controller_count", agg="sum"),)),
    Rule("kafka:cluster:is_healthy", "a is k and b is 1 and c is 0", (Operand("up", match=(("job", "kafka-jmx"),), where=("==", 1), agg="count"), Operand("kafka_controller_active_controller_count", agg="sum"), Operand("kafka_controller_offline_partitions_count", agg="sum")), 3),
    Rule("kafka:cluster:offline_partitions", "a", (Operand("kafka_controller_offline_partitions_count", agg="sum"),)),
    Rule("kafka:cluster:under_replicated_partitions", "a", (Operand("kafka_server_replica_manager_under_replicated_partitions", agg="sum"),)),
    Rule("kafka:cluster:under_min_isr_partitions", "a", (Operand("kafka_server_replica_manager_under_min_isr_partition_count", agg="sum"),)),
    Rule("kafka:cluster:partition_count", "a", (Operand("kafka_server_replica_manager_partition_count", agg="sum"),)),
    Rule("kafka:cluster:leader_count", "a", (Operand("kafka_server_replica_manager_leader_count", agg="sum"),)),
    Rule("kafka:replication:isr_shrinks_rate:5m", "a", (Operand("kafka_server_replica_manager_isr_shrinks_total", "rate", 300, agg="sum"),)),
    Rule("kafka:replication:isr_expands_rate:5m", "a", (Operand("kafka_server_replica_manager_isr_expands_total", "rate", 300, agg="sum"),)),
    Rule("kafka:throughput:messages_in_rate:5m", "a", (Operand("kafka_server_broker_topic_metrics_messages_in_total_all", "rate", 300, agg="sum"),)),
    Rule("kafka:throughput:messages_in_rate:5m:by_broker", "a", (Operand("kafka_server_broker_topic_metrics_messages_in_total_all", "rate", 300),)),
    Rule("kafka:throughput:messages_in_rate:5m:by_topic", "a", (Operand("kafka_server_broker_topic_metrics_messages_in_total", "rate", 300, agg="sum", by=("topic",)),)),
    Rule("kafka:throughput:bytes_in_rate:5m", "a", (Operand("kafka_server_broker_topic_metrics_bytes_in_total_all", "rate", 300, agg="sum"),)),
    Rule("kafka:throughput:bytes_in_rate:5m:by_broker", "a", (Operand("kafka_server_broker_topic_metrics_bytes_in_total_all", "rate", 300),)),
    Rule("kafka:throughput:bytes_in_rate:5m:by_topic", "a", (Operand("kafka_server_broker_topic_metrics_bytes_in_total", "rate", 300, agg="sum", by=("topic",)),)),
    Rule("kafka:throughput:bytes_out_rate:5m", "a", (Operand("kafka_server_broker_topic_metrics_bytes_out_total_all", "rate", 300, agg="sum"),)),
    Rule("kafka:throughput:bytes_out_rate:5m:by_broker", "a", (Operand("kafka_server_broker_topic_metrics_bytes_out_total_all", "rate", 300),)),
    Rule("kafka:throughput:bytes_out_rate:5m:by_topic", "a", (Operand("kafka_server_broker_topic_metrics_bytes_out_total", "rate", 300, agg="sum", by=("topic",)),)),
    Rule("kafka:throughput:failed_produce_rate:5m", "a", (Operand("kafka_server_broker_topic_metrics_failed_produce_requests_total", "rate", 300, agg="sum"),)),
    Rule("kafka:throughput:failed_fetch_rate:5m", "a", (Operand("kafka_server_broker_topic_metrics_failed_fetch_requests_total", "rate", 300, agg="sum"),)),
    Rule("kafka:throughput:bytes_rejected_rate:5m", "a", (Operand("kafka_server_broker_topic_metrics_bytes_rejected_total", "rate", 300, agg="sum"),)),
    Rule("kafka:request:produce_rate:5m", "a", (Operand("kafka_network_request_metrics_requests_total", "rate", 300, match=(("request", "Produce"),), agg="sum"),)),
    Rule("kafka:request:fetch_rate:5m", "a", (Operand("kafka_network_request_metrics_requests_total", "rate", 300, match=(("request", "Fetch"),), agg="sum"),)),
    Rule("kafka:request:fetch_consumer_rate:5m", "a", (Operand("kafka_network_request_metrics_requests_total", "rate", 300, match=(("request", "FetchConsumer"),), agg="sum"),)),
    Rule("kafka:request:fetch_follower_rate:5m", "a", (Operand("kafka_network_request_metrics_requests_total", "rate", 300, match=(("request", "FetchFollower"),), agg="sum"),)),
    Rule("kafka:request:produce_total_time_p99", "a", (Operand("kafka_network_request_total_time_ms", match=(("request", "Produce"), ("quantile", "0.99")), agg="avg"),)),
    Rule("kafka:request:fetch_total_time_p99", "a", (Operand("kafka_network_request_total_time_ms", match=(("request", "Fetch"), ("quantile", "0.99")), agg="avg"),)),
    Rule("kafka:request:produce_queue_time_p99", "a", (Operand("kafka_network_request_queue_time_ms", match=(("request", "Produce"), ("quantile", "0.99")), agg="avg"),)),
    Rule("kafka:request:fetch_queue_time_p99", "a", (Operand("kafka_network_request_queue_time_ms", match=(("request", "Fetch"), ("quantile", "0.99")), agg="avg"),)),
    Rule("kafka:consumer:lag_total", "a", (Operand("kafka_consumergroup_lag", agg="sum"),)),
    Rule("kafka:consumer:lag_by_group", "a", (Operand("kafka_consumergroup_lag", agg="sum", by=("consumergroup",)),)),
    Rule("kafka:consumer:lag_by_topic", "a", (Operand("kafka_consumergroup_lag", agg="sum", by=("topic",)),)),
    Rule("kafka:consumer:lag_by_group_topic", "a", (Operand("kafka_consumergroup_lag", agg="sum", by=("consumergroup", "topic")),)),
    Rule("_kafka:groups", "a", (Operand("kafka_consumergroup_members", agg="count", by=("consumergroup",)),)),
    Rule("kafka:consumer:group_count", "a", (Operand("_kafka:groups", agg="count"),)),
    Rule("kafka:consumer:members_by_group", "a", (Operand("kafka_consumergroup_members"),)),
    Rule("kafka:consumer:current_offset_rate:5m", "a", (Operand("kafka_consumergroup_current_offset", "rate", 300, agg="sum", by=("consumergroup", "topic")),)),
    Rule("kafka:jvm:heap_usage_ratio", "a/b", (Operand("jvm_memory_heap_used_bytes"), Operand("jvm_memory_heap_max_bytes"))),
    Rule("kafka:jvm:heap_usage_ratio:by_broker", "a/b", (Operand("jvm_memory_heap_used_bytes"), Operand("jvm_memory_heap_max_bytes"))),
    Rule("kafka:jvm:heap_used_bytes", "a", (Operand("jvm_memory_heap_used_bytes"),)),
    Rule("kafka:jvm:heap_max_bytes", "a", (Operand("jvm_memory_heap_max_bytes"),)),
    Rule("kafka:jvm:thread_count", "a", (Operand("jvm_threads_current"),)),
    Rule("kafka:jvm:gc_time_rate:5m", "a/k", (Operand("jvm_gc_collection_time_ms", "rate", 300),), 1000),
    Rule("kafka:jvm:gc_count_rate:5m", "a", (Operand("jvm_gc_collection_count", "rate", 300),)),
    Rule("kafka:jvm:fd_usage_ratio", "a/b", (Operand("jvm_os_open_file_descriptor_count"), Operand("jvm_os_max_file_descriptor_count"))),
    Rule("kafka:performance:network_processor_idle", "a", (Operand("kafka_network_socket_server_network_processor_avg_idle_percent"),)),
    Rule("kafka:performance:request_handler_idle", "a", (Operand("kafka_server_request_handler_avg_idle_percent"),)),
    Rule("kafka:performance:purgatory_size:produce", "a", (Operand("kafka_server_delayed_operation_purgatory_size", match=(("operation", "Produce"),)),)),
    Rule("kafka:performance:purgatory_size:fetch", "a", (Operand("kafka_server_delayed_operation_purgatory_size", match=(("operation", "Fetch"),)),)),
    Rule("_kafka:topics", "a", (Operand("kafka_topic_partitions", agg="count", by=("topic",)),)),
    Rule("kafka:topic:count", "a", (Operand("_kafka:topics", agg="count"),)),
    Rule("kafka:topic:partition_count", "a", (Operand("kafka_topic_partitions"),)),
    Rule("kafka:topic:size_bytes", "a", (Operand("kafka_log_size_bytes", agg="sum", by=("topic",)),)),
    Rule("kafka:topic:log_end_offset", "a", (Operand("kafka_log_end_offset", agg="sum", by=("topic",)),)),
    Rule("logstash:availability:up", "a", (Operand("probe_success", match=(("job", "blackbox-logstash"),)),)),
    Rule("logstash:availability:probe_duration_seconds", "a", (Operand("probe_duration_seconds", match=(("job", "blackbox-logstash"),)),)),
    Rule("logstash:pipeline:events_in_total", "a", (Operand("logstash_node_pipeline_events_in_total"),)),
    Rule("logstash:pipeline:events_out_total", "a", (Operand("logstash_node_pipeline_events_out_total"),)),
    Rule("logstash:pipeline:events_filtered_total", "a", (Operand("logstash_node_pipeline_events_filtered_total"),)),
    Rule("logstash:pipeline:events_in_rate:5m", "a", (Operand("logstash_node_pipeline_events_in_total", "rate", 300),)),
    Rule("logstash:pipeline:events_out_rate:5m", "a", (Operand("logstash_node_pipeline_events_out_total", "rate", 300),)),
    Rule("logstash:pipeline:events_filtered_rate:5m", "a", (Operand("logstash_node_pipeline_events_filtered_total", "rate", 300),)),
    Rule("logstash:pipeline:throughput_eps", "a", (Operand("logstash_node_pipeline_events_out_total", "irate", 60),)),
    Rule("logstash:pipeline:throughput_eps:5m_avg", "a", (Operand("logstash_node_pipeline_events_out_total", "rate", 300),)),
    Rule("logstash:pipeline:filter_ratio", "a/b", (Operand("logstash_node_pipeline_events_filtered_total", "rate", 300), Operand("logstash_node_pipeline_events_in_total", "rate", 300))),
    Rule("logstash:latency:queue_push_duration_ms", "a", (Operand("logstash_node_pipeline_queue_push_duration_in_millis"),)),
    Rule("logstash:latency:queue_push_duration_rate:5m", "a", (Operand("logstash_node_pipeline_queue_push_duration_in_millis", "rate", 300),)),
    Rule("logstash:latency:filter_duration_rate:5m", "a", (Operand("logstash_node_pipeline_plugins_filters_events_duration_in_millis", "rate", 300),)),
    Rule("logstash:latency:output_duration_rate:5m", "a", (Operand("logstash_node_pipeline_plugins_outputs_events_duration_in_millis", "rate", 300),)),
    Rule("logstash:latency:filter_avg_ms", "a/b", (Operand("logstash_node_pipeline_plugins_filters_events_duration_in_millis", "rate", 300), Operand("logstash_node_pipeline_plugins_filters_events_out_total", "rate", 300))),
    Rule("logstash:latency:output_avg_ms", "a/b", (Operand("logstash_node_pipeline_plugins_outputs_events_duration_in_millis", "rate", 300), Operand("logstash_node_pipeline_plugins_outputs_events_out_total", "rate", 300))),
    Rule("logstash:queue:events_count", "a", (Operand("logstash_node_pipeline_queue_events_count"),)),
    Rule("logstash:queue:size_bytes", "a", (Operand("logstash_node_pipeline_queue_size_in_bytes"),)),
    Rule("logstash:queue:max_size_bytes", "a", (Operand("logstash_node_pipeline_queue_max_size_in_bytes"),)),
    Rule("logstash:queue:usage_ratio", "a/b", (Operand("logstash_node_pipeline_queue_size_in_bytes"), Operand("logstash_node_pipeline_queue_max_size_in_bytes"))),
    Rule("logstash:jvm:heap_used_bytes", "a", (Operand("logstash_node_jvm_mem_heap_used_in_bytes"),)),
    Rule("logstash:jvm:heap_max_bytes", "a", (Operand("logstash_node_jvm_mem_heap_max_in_bytes"),)),
    Rule("logstash:jvm:heap_committed_bytes", "a", (Operand("logstash_node_jvm_mem_heap_committed_in_bytes"),)),
    Rule("logstash:jvm:non_heap_used_bytes", "a", (Operand("logstash_node_jvm_mem_non_heap_used_in_bytes"),)),
    Rule("logstash:jvm:threads_count", "a", (Operand("logstash_node_jvm_threads_count"),)),
    Rule("logstash:jvm:threads_peak_count", "a", (Operand("logstash_node_jvm_threads_peak_count"),)),
    Rule("logstash:jvm:heap_usage_ratio", "a/b", (Operand("logstash_node_jvm_mem_heap_used_in_bytes"), Operand("logstash_node_jvm_mem_heap_max_in_bytes"))),
    Rule("logstash:jvm:gc_old_time_rate:5m", "a/k", (Operand("logstash_node_jvm_gc_collectors_old_collection_time_in_millis", "rate", 300),), 1000),
    Rule("logstash:jvm:gc_old_count_rate:5m", "a", (Operand("logstash_node_jvm_gc_collectors_old_collection_count", "rate", 300),)),
    Rule("logstash:jvm:gc_young_time_rate:5m", "a/k", (Operand("logstash_node_jvm_gc_collectors_young_collection_time_in_millis", "rate", 300),), 1000),
    Rule("logstash:jvm:gc_young_count_rate:5m", "a", (Operand("logstash_node_jvm_gc_collectors_young_collection_count", "rate", 300),)),
    Rule("logstash:plugin:input_events_rate:5m", "a", (Operand("logstash_node_pipeline_plugins_inputs_events_out_total", "rate", 300),)),
    Rule("logstash:plugin:input_queue_push_rate:5m", "a", (Operand("logstash_node_pipeline_plugins_inputs_events_queue_push_duration_in_millis", "rate", 300),)),
    Rule("logstash:plugin:filter_events_rate:5m", "a", (Operand("logstash_node_pipeline_plugins_filters_events_out_total", "rate", 300),)),
    Rule("logstash:plugin:filter_duration_rate:5m", "a", (Operand("logstash_node_pipeline_plugins_filters_events_duration_in_millis", "rate", 300),)),
    Rule("logstash:plugin:output_events_rate:5m", "a", (Operand("logstash_node_pipeline_plugins_outputs_events_out_total", "rate", 300),)),
    Rule("logstash:plugin:output_duration_rate:5m", "a", (Operand("logstash_node_pipeline_plugins_outputs_events_duration_in_millis", "rate", 300),)),
    Rule("logstash:plugin:output_success_rate", "a/b", (Operand("logstash_node_pipeline_plugins_outputs_documents_successes_total", "rate", 300), Operand("logstash_node_pipeline_plugins_outputs_events_out_total", "rate", 300))),
    Rule("logstash:dlq:size_bytes", "a", (Operand("logstash_node_dead_letter_queue_size_in_bytes"),)),
    Rule("logstash:dlq:max_size_bytes", "a", (Operand("logstash_node_dead_letter_queue_max_size_in_bytes"),)),
    Rule("logstash:dlq:usage_ratio", "a/b", (Operand("logstash_node_dead_letter_queue_size_in_bytes"), Operand("logstash_node_dead_letter_queue_max_size_in_bytes"))),
    Rule("logstash:dlq:growth_rate:1h", "a", (Operand("logstash_node_dead_letter_queue_size_in_bytes", "increase", 3600),)),
    Rule("slo:elasticsearch:availability:target", "const", (), 0.999),
    Rule("slo:elasticsearch:availability:current", "a", (Operand("elasticsearch:cluster:is_healthy", "avg", 3600),)),
    Rule("slo:elasticsearch:availability:budget_consumed", "(1-a)/(1-k)", (Operand("elasticsearch:cluster:is_healthy", "avg", 3600),), 0.999),
    Rule("slo:elasticsearch:availability:budget_remaining", "1-(1-a)/(1-k)", (Operand("elasticsearch:cluster:is_healthy", "avg", 3600),), 0.999),
    Rule("slo:elasticsearch:latency:target_seconds", "const", (), 0.5),
    Rule("slo:elasticsearch:latency:current_p95", "quantile", (Operand("elasticsearch_http_request_duration_seconds_bucket", "rate", 300, agg="sum", by=("le",)),), 0.95),
    Rule("slo:elasticsearch:latency:within_target", "a<k", (Operand("slo:elasticsearch:latency:current_p95"),), 0.5),
    Rule("slo:kafka:availability:target", "const", (), 0.999),
    Rule("slo:kafka:availability:current", "a", (Operand("kafka:cluster:is_healthy", "avg", 3600),)),
    Rule("slo:kafka:availability:budget_consumed", "(1-a)/(1-k)", (Operand("kafka:cluster:is_healthy", "avg", 3600),), 0.999),
    Rule("slo:kafka:availability:budget_remaining", "1-(1-a)/(1-k)", (Operand("kafka:cluster:is_healthy", "avg", 3600),), 0.999),
    Rule("slo:kafka:produce_latency:target_ms", "const", (), 100),
    Rule("slo:kafka:produce_latency:current_p99", "a", (Operand("kafka_network_request_total_time_ms", match=(("request", "Produce"), ("quantile", "0.99")), agg="avg"),)),
    Rule("slo:kafka:produce_latency:within_target", "a<k", (Operand("kafka_network_request_total_time_ms", match=(("request", "Produce"), ("quantile", "0.99")), agg="avg"),), 100),
    Rule("slo:kafka:consumer_lag:target", "const", (), 1000),
    Rule("slo:kafka:consumer_lag:max", "a", (Operand("kafka:consumer:lag_by_group_topic", agg="max"),)),
    Rule("slo:kafka:consumer_lag:within_target", "a<k", (Operand("kafka:consumer:lag_by_group_topic", agg="max"),), 1000),
    Rule("slo:logstash:availability:target", "const", (), 0.999),
    Rule("slo:logstash:availability:current", "a", (Operand("logstash:availability:up", "avg", 3600),)),
    Rule("slo:logstash:availability:budget_consumed", "(1-a)/(1-k)", (Operand("logstash:availability:up", "avg", 3600),), 0.999),
    Rule("slo:logstash:availability:budget_remaining", "1-(1-a)/(1-k)", (Operand("logstash:availability:up", "avg", 3600),), 0.999),
    Rule("slo:logstash:throughput:events_per_second", "a", (Operand("logstash:pipeline:throughput_eps:5m_avg"),)),
    Rule("slo:logstash:latency:target_ms", "const", (), 500),
    Rule("slo:logstash:latency:output_current", "a/b", (Operand("logstash_node_pipeline_plugins_outputs_events_duration_in_millis", "rate", 300), Operand("logstash_node_pipeline_plugins_outputs_events_out_total", "rate", 300))),
    Rule("slo:logstash:latency:within_target", "a/b<k", (Operand("logstash_node_pipeline_plugins_outputs_events_duration_in_millis", "rate", 300), Operand("logstash_node_pipeline_plugins_outputs_events_out_total", "rate", 300)), 500),
)


def _words(name):
    out = ""
    for i, ch in enumerate(name):
        out += (" " if i and ch.isupper() and not name[i - 1].isupper() else "") + ch
    return out


VALUE, PERCENT, TIME = "{{ $value }}", "{{ $value | humanizePercentage }}", "{{ $value | humanizeDuration }}"


def _alert(service, category, name, hold, severity, rule, compare, value):
    """One alert; summary and description are spelled from its name, its value and the labels of its series."""
    op, limit = compare or ("", 0)
    return Alert(
        name, rule, compare, hold, severity, service, category, summary=_words(name),
        description=f"{_words(name)} on {{{{ $labels.instance }}}}: value {value}, condition {op} {limit:g}",
    )


# Alerts: service, category, name, hold in seconds, severity, condition, limit, form of the value.
ALERT_RULES = (
    _alert("elasticsearch", "cluster", "ElasticsearchClusterRed", 60, "critical", Rule("ElasticsearchClusterRed", "a", (Operand("elasticsearch_cluster_health_status", match=(("color", "red"),)),)), ("==", 1), VALUE),
    _alert("elasticsearch", "cluster", "ElasticsearchClusterYellow", 300, "warning", Rule("ElasticsearchClusterYellow", "a", (Operand("elasticsearch_cluster_health_status", match=(("color", "yellow"),)),)), ("==", 1), VALUE),
    _alert("elasticsearch", "cluster", "ElasticsearchClusterStatusUnknown", 300, "critical", Rule("ElasticsearchClusterStatusUnknown", "absent", (Operand("elasticsearch_cluster_health_status"),)), ("==", 1), VALUE),
    _alert("elasticsearch", "nodes", "ElasticsearchNodeDown", 60, "critical", Rule("ElasticsearchNodeDown", "a", (Operand("elasticsearch_cluster_health_number_of_nodes"),)), ("<", 3), VALUE),
    _alert("elasticsearch", "nodes", "ElasticsearchDataNodeDown", 60, "critical", Rule("ElasticsearchDataNodeDown", "a", (Operand("elasticsearch_cluster_health_number_of_data_nodes"),)), ("<", 3), VALUE),
    _alert("elasticsearch", "shards", "ElasticsearchUnassignedShards", 300, "warning", Rule("ElasticsearchUnassignedShards", "a", (Operand("elasticsearch_cluster_health_unassigned_shards"),)), (">", 0), VALUE),
    _alert("elasticsearch", "shards", "ElasticsearchUnassignedShardsCritical", 120, "critical", Rule("ElasticsearchUnassignedShardsCritical", "a", (Operand("elasticsearch_cluster_health_unassigned_shards"),)), (">", 10), VALUE),
    _alert("elasticsearch", "shards", "ElasticsearchRelocatingShards", 1800, "warning", Rule("ElasticsearchRelocatingShards", "a", (Operand("elasticsearch_cluster_health_relocating_shards"),)), (">", 0), VALUE),
    _alert("elasticsearch", "shards", "ElasticsearchInitializingShards", 900, "warning", Rule("ElasticsearchInitializingShards", "a", (Operand("elasticsearch_cluster_health_initializing_shards"),)), (">", 0), VALUE),
    _alert("elasticsearch", "jvm", "ElasticsearchHeapUsageWarning", 300, "warning", Rule("ElasticsearchHeapUsageWarning", "a", (Operand("elasticsearch:jvm:heap_usage_ratio"),)), (">", 0.8), PERCENT),
    _alert("elasticsearch", "jvm", "ElasticsearchHeapUsageCritical", 120, "critical", Rule("ElasticsearchHeapUsageCritical", "a", (Operand("elasticsearch:jvm:heap_usage_ratio"),)), (">", 0.9), PERCENT),
    _alert("elasticsearch", "jvm", "ElasticsearchHeapUsageDangerous", 60, "critical", Rule("ElasticsearchHeapUsageDangerous", "a", (Operand("elasticsearch:jvm:heap_usage_ratio"),)), (">", 0.95), PERCENT),
    _alert("elasticsearch", "jvm", "ElasticsearchGCPressureHigh", 300, "warning", Rule("ElasticsearchGCPressureHigh", "a", (Operand("elasticsearch:jvm:gc_time_rate:5m"),)), (">", 0.5), PERCENT),
    _alert("elasticsearch", "performance", "ElasticsearchSearchLatencyWarning", 600, "warning", Rule("ElasticsearchSearchLatencyWarning", "a", (Operand("elasticsearch:search:query_latency_avg:5m"),)), (">", 0.5), TIME),
    _alert("elasticsearch", "performance", "ElasticsearchSearchLatencyCritical", 300, "critical", Rule("ElasticsearchSearchLatencyCritical", "a", (Operand("elasticsearch:search:query_latency_avg:5m"),)), (">", 2), TIME),
    _alert("elasticsearch", "performance", "ElasticsearchIndexingRateDrop", 900, "warning", Rule("ElasticsearchIndexingRateDrop", "a and b", (Operand("elasticsearch:indexing:rate:5m", where=("<", 10)), Operand("elasticsearch:indexing:rate:5m", where=(">", 100), back=3600))), None, VALUE),
    _alert("elasticsearch", "performance", "ElasticsearchIndexingLatencyHigh", 600, "warning", Rule("ElasticsearchIndexingLatencyHigh", "a", (Operand("elasticsearch:indexing:latency_avg:5m"),)), (">", 0.1), TIME),
    _alert("elasticsearch", "disk", "ElasticsearchDiskUsageWarning", 300, "warning", Rule("ElasticsearchDiskUsageWarning", "a", (Operand("elasticsearch:disk:usage_ratio"),)), (">", 0.75), PERCENT),
    _alert("elasticsearch", "disk", "ElasticsearchDiskUsageCritical", 120, "critical", Rule("ElasticsearchDiskUsageCritical", "a", (Operand("elasticsearch:disk:usage_ratio"),)), (">", 0.85), PERCENT),
    _alert("elasticsearch", "disk", "ElasticsearchDiskUsageDangerous", 60, "critical", Rule("ElasticsearchDiskUsageDangerous", "a", (Operand("elasticsearch:disk:usage_ratio"),)), (">", 0.9), PERCENT),
    _alert("elasticsearch", "disk", "ElasticsearchDiskWillFillIn24h", 1800, "warning", Rule("ElasticsearchDiskWillFillIn24h", "a", (Operand("elasticsearch:disk:free_bytes", "predict", 21600, horizon=86400),)), ("<", 0), VALUE),
    _alert("elasticsearch", "disk", "ElasticsearchDiskWillFillIn6h", 900, "critical", Rule("ElasticsearchDiskWillFillIn6h", "a", (Operand("elasticsearch:disk:free_bytes", "predict", 7200, horizon=21600),)), ("<", 0), VALUE),
    _alert("elasticsearch", "threadpool", "ElasticsearchSearchRejections", 300, "warning", Rule("ElasticsearchSearchRejections", "a", (Operand("elasticsearch:threadpool:rejected_rate:5m:search"),)), (">", 0), VALUE),
    _alert("elasticsearch", "threadpool", "ElasticsearchWriteRejections", 300, "warning", Rule("ElasticsearchWriteRejections", "a", (Operand("elasticsearch:threadpool:rejected_rate:5m:write"),)), (">", 0), VALUE),
    _alert("elasticsearch", "threadpool", "ElasticsearchSearchQueueHigh", 300, "warning", Rule("ElasticsearchSearchQueueHigh", "a", (Operand("elasticsearch:threadpool:queue_size:search"),)), (">", 100), VALUE),
    _alert("elasticsearch", "threadpool", "ElasticsearchWriteQueueHigh", 300, "warning", Rule("ElasticsearchWriteQueueHigh", "a", (Operand("elasticsearch:threadpool:queue_size:write"),)), (">", 100), VALUE),
    _alert("elasticsearch", "memory", "ElasticsearchParentBreakerWarning", 300, "warning", Rule("ElasticsearchParentBreakerWarning", "a", (Operand("elasticsearch:breaker:parent:usage_ratio"),)), (">", 0.75), PERCENT),
    _alert("elasticsearch", "memory", "ElasticsearchParentBreakerCritical", 120, "critical", Rule("ElasticsearchParentBreakerCritical", "a", (Operand("elasticsearch:breaker:parent:usage_ratio"),)), (">", 0.9), PERCENT),
    _alert("elasticsearch", "memory", "ElasticsearchFielddataBreakerHigh", 300, "warning", Rule("ElasticsearchFielddataBreakerHigh", "a", (Operand("elasticsearch:breaker:fielddata:usage_ratio"),)), (">", 0.75), PERCENT),
    _alert("elasticsearch", "memory", "ElasticsearchCircuitBreakerTripped", 60, "critical", Rule("ElasticsearchCircuitBreakerTripped", "a", (Operand("elasticsearch:breaker:tripped_rate:5m"),)), (">", 0), VALUE),
    _alert("elasticsearch", "resources", "ElasticsearchHighCPU", 600, "warning", Rule("ElasticsearchHighCPU", "a", (Operand("elasticsearch:os:cpu_percent"),)), (">", 85), VALUE),
    _alert("elasticsearch", "resources", "ElasticsearchHighCPUCritical", 300, "critical", Rule("ElasticsearchHighCPUCritical", "a", (Operand("elasticsearch:os:cpu_percent"),)), (">", 95), VALUE),
    _alert("elasticsearch", "resources", "ElasticsearchHighLoadAverage", 600, "warning", Rule("ElasticsearchHighLoadAverage", "a", (Operand("elasticsearch:os:load_average_5m"),)), (">", 4), VALUE),
    _alert("elasticsearch", "resources", "ElasticsearchFileDescriptorsWarning", 300, "warning", Rule("ElasticsearchFileDescriptorsWarning", "a", (Operand("elasticsearch:process:fds_usage_ratio"),)), (">", 0.75), PERCENT),
    _alert("elasticsearch", "resources", "ElasticsearchFileDescriptorsCritical", 120, "critical", Rule("ElasticsearchFileDescriptorsCritical", "a", (Operand("elasticsearch:process:fds_usage_ratio"),)), (">", 0.9), PERCENT),
    _alert("elasticsearch", "cache", "ElasticsearchQueryCacheEvictions", 600, "warning", Rule("ElasticsearchQueryCacheEvictions", "a", (Operand("elasticsearch:cache:query:evictions_rate:5m"),)), (">", 100), VALUE),
    _alert("elasticsearch", "cache", "ElasticsearchFielddataEvictions", 600, "warning", Rule("ElasticsearchFielddataEvictions", "a", (Operand("elasticsearch:fielddata:evictions_rate:5m"),)), (">", 10), VALUE),
    _alert("", "availability", "EndpointDown", 60, "critical", Rule("EndpointDown", "a", (Operand("probe_success"),)), ("==", 0), VALUE),
    _alert("", "performance", "EndpointSlowResponse", 300, "warning", Rule("EndpointSlowResponse", "a", (Operand("probe_duration_seconds"),)), (">", 5), TIME),
    _alert("", "ssl", "SSLCertificateExpiringSoon", 3600, "warning", Rule("SSLCertificateExpiringSoon", "a", (Operand("probe:ssl_cert_expiry_days"),)), ("<", 30), VALUE),
    _alert("", "ssl", "SSLCertificateExpiringCritical", 3600, "critical", Rule("SSLCertificateExpiringCritical", "a", (Operand("probe:ssl_cert_expiry_days"),)), ("<", 7), VALUE),
    _alert("", "ssl", "SSLCertificateExpired", 0, "critical", Rule("SSLCertificateExpired", "a", (Operand("probe:ssl_cert_expiry_days"),)), ("<", 0), VALUE),
    _alert("", "slo", "SLOBudgetBurning", 300, "warning", Rule("SLOBudgetBurning", "a", (Operand("slo:elasticsearch:availability:budget_remaining"),)), ("<", 0.5), PERCENT),
    _alert("", "slo", "SLOBudgetCritical", 300, "critical", Rule("SLOBudgetCritical", "a", (Operand("slo:elasticsearch:availability:budget_remaining"),)), ("<", 0.2), PERCENT),
    _alert("", "slo", "SLOBudgetExhausted", 0, "critical", Rule("SLOBudgetExhausted", "a", (Operand("slo:elasticsearch:availability:budget_remaining"),)), ("<", 0), PERCENT),
    _alert("otel-collector", "", "OtelCollectorRefusingData", 300, "warning", Rule("OtelCollectorRefusingData", "a", (Operand("otel:receiver:refused_rate:5m"),)), (">", 0), VALUE),
    _alert("otel-collector", "", "OtelCollectorExportFailures", 300, "warning", Rule("OtelCollectorExportFailures", "a", (Operand("otel:exporter:failed_rate:5m"),)), (">", 0), VALUE),
    _alert("prometheus", "", "PrometheusTargetDown", 300, "warning", Rule("PrometheusTargetDown", "a", (Operand("up"),)), ("==", 0), VALUE),
    _alert("prometheus", "", "PrometheusConfigurationReloadFailure", 300, "warning", Rule("PrometheusConfigurationReloadFailure", "a", (Operand("prometheus_config_last_reload_successful"),)), ("!=", 1), VALUE),
    _alert("prometheus", "", "PrometheusTSDBCompactionsFailing", 0, "warning", Rule("PrometheusTSDBCompactionsFailing", "a", (Operand("prometheus_tsdb_compactions_failed_total", "increase", 3600),)), (">", 0), VALUE),
    _alert("kafka", "cluster", "KafkaBrokerDown", 60, "critical", Rule("KafkaBrokerDown", "a", (Operand("up", match=(("job", "kafka-jmx"),), where=("==", 1), agg="count"),)), ("<", 3), VALUE),
    _alert("kafka", "cluster", "KafkaBrokerNotAvailable", 60, "critical", Rule("KafkaBrokerNotAvailable", "a", (Operand("up", match=(("job", "kafka-jmx"),)),)), ("==", 0), VALUE),
    _alert("kafka", "controller", "KafkaNoActiveController", 60, "critical", Rule("KafkaNoActiveController", "a", (Operand("kafka_controller_active_controller_count", agg="sum"),)), ("==", 0), VALUE),
    _alert("kafka", "controller", "KafkaMultipleControllers", 60, "critical", Rule("KafkaMultipleControllers", "a", (Operand("kafka_controller_active_controller_count", agg="sum"),)), (">", 1), VALUE),
    _alert("kafka", "partitions", "KafkaOfflinePartitions", 60, "critical", Rule("KafkaOfflinePartitions", "a", (Operand("kafka_controller_offline_partitions_count", agg="sum"),)), (">", 0), VALUE),
    _alert("kafka", "replication", "KafkaUnderReplicatedPartitions", 300, "warning", Rule("KafkaUnderReplicatedPartitions", "a", (Operand("kafka_server_replica_manager_under_replicated_partitions", agg="sum"),)), (">", 0), VALUE),
    _alert("kafka", "replication", "KafkaUnderReplicatedPartitionsCritical", 120, "critical", Rule("KafkaUnderReplicatedPartitionsCritical", "a", (Operand("kafka_server_replica_manager_under_replicated_partitions", agg="sum"),)), (">", 10), VALUE),
    _alert("kafka", "replication", "KafkaUnderMinIsrPartitions", 120, "critical", Rule("KafkaUnderMinIsrPartitions", "a", (Operand("kafka_server_replica_manager_under_min_isr_partition_count", agg="sum"),)), (">", 0), VALUE),
    _alert("kafka", "replication", "KafkaIsrShrinking", 600, "warning", Rule("KafkaIsrShrinking", "a", (Operand("kafka_server_replica_manager_isr_shrinks_total", "rate", 300),)), (">", 0), VALUE),
    _alert("kafka", "consumer", "KafkaConsumerLagHigh", 300, "warning", Rule("KafkaConsumerLagHigh", "a", (Operand("kafka_consumergroup_lag", agg="sum", by=("consumergroup", "topic")),)), (">", 1000), VALUE),
    _alert("kafka", "consumer", "KafkaConsumerLagCritical", 120, "critical", Rule("KafkaConsumerLagCritical", "a", (Operand("kafka_consumergroup_lag", agg="sum", by=("consumergroup", "topic")),)), (">", 10000), VALUE),
    _alert("kafka", "consumer", "KafkaConsumerLagGrowing", 600, "warning", Rule("KafkaConsumerLagGrowing", "a", (Operand("kafka_consumergroup_lag", "delta", 600),)), (">", 1000), VALUE),
    _alert("kafka", "consumer", "KafkaConsumerGroupEmpty", 300, "warning", Rule("KafkaConsumerGroupEmpty", "a", (Operand("kafka_consumergroup_members"),)), ("==", 0), VALUE),
    _alert("kafka", "topic", "KafkaTopicPartitionCountChanged", 60, "info", Rule("KafkaTopicPartitionCountChanged", "a", (Operand("kafka_topic_partitions", "changes", 3600),)), (">", 0), VALUE),
    _alert("kafka", "topic", "KafkaTopicNoMessages", 1800, "warning", Rule("KafkaTopicNoMessages", "a and b", (Operand("kafka_server_broker_topic_metrics_messages_in_total", "rate", 300, where=("==", 0)), Operand("kafka_server_broker_topic_metrics_messages_in_total", "rate", 3600, where=(">", 10), back=3600))), None, VALUE),
    _alert("kafka", "performance", "KafkaProduceRequestLatencyHigh", 300, "warning", Rule("KafkaProduceRequestLatencyHigh", "a", (Operand("kafka_network_request_total_time_ms", match=(("request", "Produce"), ("quantile", "0.99"))),)), (">", 100), VALUE),
    _alert("kafka", "performance", "KafkaFetchRequestLatencyHigh", 300, "warning", Rule("KafkaFetchRequestLatencyHigh", "a", (Operand("kafka_network_request_total_time_ms", match=(("request", "Fetch"), ("quantile", "0.99"))),)), (">", 100), VALUE),
    _alert("kafka", "performance", "KafkaFailedProduceRequests", 300, "warning", Rule("KafkaFailedProduceRequests", "a", (Operand("kafka_server_broker_topic_metrics_failed_produce_requests_total", "rate", 300),)), (">", 0), VALUE),
    _alert("kafka", "performance", "KafkaFailedFetchRequests", 300, "warning", Rule("KafkaFailedFetchRequests", "a", (Operand("kafka_server_broker_topic_metrics_failed_fetch_requests_total", "rate", 300),)), (">", 0), VALUE),
    _alert("kafka", "performance", "KafkaNetworkProcessorIdleLow", 300, "warning", Rule("KafkaNetworkProcessorIdleLow", "a", (Operand("kafka_network_socket_server_network_processor_avg_idle_percent"),)), ("<", 0.3), PERCENT),
    _alert("kafka", "performance", "KafkaRequestHandlerIdleLow", 300, "warning", Rule("KafkaRequestHandlerIdleLow", "a", (Operand("kafka_server_request_handler_avg_idle_percent"),)), ("<", 0.3), PERCENT),
    _alert("kafka", "jvm", "KafkaJvmHeapUsageWarning", 300, "warning", Rule("KafkaJvmHeapUsageWarning", "a/b", (Operand("jvm_memory_heap_used_bytes"), Operand("jvm_memory_heap_max_bytes"))), (">", 0.8), PERCENT),
    _alert("kafka", "jvm", "KafkaJvmHeapUsageCritical", 120, "critical", Rule("KafkaJvmHeapUsageCritical", "a/b", (Operand("jvm_memory_heap_used_bytes"), Operand("jvm_memory_heap_max_bytes"))), (">", 0.9), PERCENT),
    _alert("kafka", "jvm", "KafkaJvmGcTimeHigh", 600, "warning", Rule("KafkaJvmGcTimeHigh", "a/k", (Operand("jvm_gc_collection_time_ms", "rate", 300),), 1000), (">", 0.3), PERCENT),
    _alert("kafka", "jvm", "KafkaFileDescriptorsHigh", 300, "warning", Rule("KafkaFileDescriptorsHigh", "a/b", (Operand("jvm_os_open_file_descriptor_count"), Operand("jvm_os_max_file_descriptor_count"))), (">", 0.8), PERCENT),
    _alert("kafka", "zookeeper", "KafkaZookeeperSessionExpired", 0, "warning", Rule("KafkaZookeeperSessionExpired", "a", (Operand("kafka_server_zookeeper_session_state", "increase", 300),)), (">", 0), VALUE),
    _alert("zookeeper", "availability", "ZookeeperDown", 60, "critical", Rule("ZookeeperDown", "a", (Operand("probe_success", match=(("job", "blackbox-zookeeper"),)),)), ("==", 0), VALUE),
    _alert("logstash", "availability", "LogstashDown", 60, "critical", Rule("LogstashDown", "a", (Operand("probe_success", match=(("job", "blackbox-logstash"),)),)), ("==", 0), VALUE),
    _alert("logstash", "availability", "LogstashEndpointUnhealthy", 120, "warning", Rule("LogstashEndpointUnhealthy", "a", (Operand("probe_http_status_code", match=(("job", "blackbox-logstash"),)),)), ("!=", 200), VALUE),
    _alert("logstash", "pipeline", "LogstashPipelineNotProcessing", 300, "warning", Rule("LogstashPipelineNotProcessing", "a and b", (Operand("logstash_node_pipeline_events_out_total", "rate", 300, where=("==", 0)), Operand("logstash_node_pipeline_events_in_total", "rate", 300, where=(">", 0)))), None, VALUE),
    _alert("logstash", "pipeline", "LogstashPipelineNoInput", 900, "warning", Rule("LogstashPipelineNoInput", "a and b", (Operand("logstash_node_pipeline_events_in_total", "rate", 600, where=("==", 0)), Operand("logstash_node_pipeline_events_in_total", "rate", 3600, where=(">", 10), back=3600))), None, VALUE),
    _alert("logstash", "pipeline", "LogstashHighFilteredRate", 600, "warning", Rule("LogstashHighFilteredRate", "a/b", (Operand("logstash_node_pipeline_events_filtered_total", "rate", 300), Operand("logstash_node_pipeline_events_in_total", "rate", 300))), (">", 0.5), PERCENT),
    _alert("logstash", "pipeline", "LogstashQueueBackpressure", 300, "warning", Rule("LogstashQueueBackpressure", "a/b", (Operand("logstash_node_pipeline_queue_push_duration_in_millis"), Operand("logstash_node_pipeline_queue_events_count"))), (">", 100), VALUE),
    _alert("logstash", "performance", "LogstashFilterLatencyHigh", 600, "warning", Rule("LogstashFilterLatencyHigh", "a/b", (Operand("logstash_node_pipeline_plugins_filters_events_duration_in_millis", "rate", 300), Operand("logstash_node_pipeline_plugins_filters_events_out_total", "rate", 300))), (">", 100), VALUE),
    _alert("logstash", "performance", "LogstashOutputLatencyHigh", 600, "warning", Rule("LogstashOutputLatencyHigh", "a/b", (Operand("logstash_node_pipeline_plugins_outputs_events_duration_in_millis", "rate", 300), Operand("logstash_node_pipeline_plugins_outputs_events_out_total", "rate", 300))), (">", 500), VALUE),
    _alert("logstash", "performance", "LogstashOutputLatencyCritical", 300, "critical", Rule("LogstashOutputLatencyCritical", "a/b", (Operand("logstash_node_pipeline_plugins_outputs_events_duration_in_millis", "rate", 300), Operand("logstash_node_pipeline_plugins_outputs_events_out_total", "rate", 300))), (">", 2000), VALUE),
    _alert("logstash", "performance", "LogstashThroughputDrop", 900, "warning", Rule("LogstashThroughputDrop", "a<b*k", (Operand("logstash_node_pipeline_events_out_total", "rate", 300), Operand("logstash_node_pipeline_events_out_total", "rate", 3600, back=3600)), 0.5), None, VALUE),
    _alert("logstash", "jvm", "LogstashJvmHeapUsageWarning", 300, "warning", Rule("LogstashJvmHeapUsageWarning", "a/b", (Operand("logstash_node_jvm_mem_heap_used_in_bytes"), Operand("logstash_node_jvm_mem_heap_max_in_bytes"))), (">", 0.75), PERCENT),
    _alert("logstash", "jvm", "LogstashJvmHeapUsageCritical", 120, "critical", Rule("LogstashJvmHeapUsageCritical", "a/b", (Operand("logstash_node_jvm_mem_heap_used_in_bytes"), Operand("logstash_node_jvm_mem_heap_max_in_bytes"))), (">", 0.9), PERCENT),
    _alert("logstash", "jvm", "LogstashJvmGcPressureHigh", 600, "warning", Rule("LogstashJvmGcPressureHigh", "a/k", (Operand("logstash_node_jvm_gc_collectors_old_collection_time_in_millis", "rate", 300),), 1000), (">", 0.3), PERCENT),
    _alert("logstash", "jvm", "LogstashJvmGcFrequent", 600, "warning", Rule("LogstashJvmGcFrequent", "a", (Operand("logstash_node_jvm_gc_collectors_old_collection_count", "rate", 300),)), (">", 0.1), VALUE),
    _alert("logstash", "dlq", "LogstashDlqGrowing", 0, "warning", Rule("LogstashDlqGrowing", "a", (Operand("logstash_node_dead_letter_queue_size_in_bytes", "increase", 3600),)), (">", 10000000), VALUE),
    _alert("logstash", "dlq", "LogstashDlqSizeHigh", 300, "warning", Rule("LogstashDlqSizeHigh", "a", (Operand("logstash_node_dead_letter_queue_size_in_bytes"),)), (">", 100000000), VALUE),
    _alert("logstash", "dlq", "LogstashDlqSizeCritical", 300, "critical", Rule("LogstashDlqSizeCritical", "a", (Operand("logstash_node_dead_letter_queue_size_in_bytes"),)), (">", 500000000), VALUE),
    _alert("logstash", "plugin", "LogstashKafkaInputErrors", 0, "warning", Rule("LogstashKafkaInputErrors", "a", (Operand("logstash_node_pipeline_plugins_inputs_events_error_total", "increase", 300, like=(("name", ".*kafka.*"),)),)), (">", 0), VALUE),
    _alert("logstash", "plugin", "LogstashElasticsearchOutputErrors", 0, "warning", Rule("LogstashElasticsearchOutputErrors", "a", (Operand("logstash_node_pipeline_plugins_outputs_events_error_total", "increase", 300, like=(("name", ".*elasticsearch.*"),)),)), (">", 0), VALUE),
    _alert("logstash", "plugin", "LogstashOutputBulkRejections", 300, "warning", Rule("LogstashOutputBulkRejections", "a/b", (Operand("logstash_node_pipeline_plugins_outputs_documents_successes_total", "rate", 300), Operand("logstash_node_pipeline_plugins_outputs_events_out_total", "rate", 300))), ("<", 0.95), PERCENT),
)
