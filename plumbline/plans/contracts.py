"""Output columns of each query with an oracle, and their types."""

COLUMNS = {
    "task_ceiling": "task string, n_mols_rep bigint, n_meas_rep bigint, sigma double, var_y double, rmse_floor double, r2_max double, mae_floor double",
    "ceiling_sensitivity": "task string, min_docs int, max_range double, n_mols_rep bigint, n_meas_rep bigint, sigma double, var_y double, rmse_floor double, r2_max double, mae_floor double",
    "doc_level": "task string, mol_id bigint, doc_id bigint, y double",
    "molecule_aggregate": "task string, mol_id bigint, y double, n_docs bigint, first_year int, structure string",
    "entity_stats": "task string, mol_id bigint, n bigint, mean double, ss double, range double",
    "task_summary": "task string, target string, type string, n_mols bigint, n_rep_mols bigint, n_docs bigint, passes boolean",
    "label_noise_factor": "task string, inv_docs double",
    "ceiling_single_label": "task string, n_mols_rep bigint, n_meas_rep bigint, sigma double, var_y double, rmse_floor double, r2_max double, mae_floor double",
    "replicate_windows": "task string, mol_id bigint, doc_id bigint, y double, n bigint, range double, deviation double, others double",
    "ceiling_bootstrap_hash": "task string, sigma_lo double, sigma_med double, sigma_hi double, rmse_floor_lo double, rmse_floor_med double, rmse_floor_hi double, r2_max_lo double, r2_max_med double, r2_max_hi double, n_valid_draws bigint",
    "ceiling_bootstrap_poisson": "task string, sigma_lo double, sigma_med double, sigma_hi double, rmse_floor_lo double, rmse_floor_med double, rmse_floor_hi double, r2_max_lo double, r2_max_med double, r2_max_hi double, n_valid_draws bigint",
    "doc_pairs": "task string, mol_id bigint, doc_a bigint, doc_b bigint, delta double, d_year int, mean_y double, same_assays boolean",
    "within_doc_pairs": "task string, mol_id bigint, doc_id bigint, assay_a bigint, assay_b bigint, delta double",
    "delta_profile": "task string, n_pairs bigint, q50 double, q75 double, q90 double, q95 double, q99 double, max double, frac_ge1 double, frac_ge2 double, frac_ge3 double, kind string",
    "big_pairs": "task string, mol_id bigint, doc_a bigint, doc_b bigint, delta double, structure string, very_big boolean",
    "sigma_from_pairs": "task string, sigma_pairs double, sigma_near double, sigma_far double, n_near bigint, n_far bigint, frac_same_assays double",
    "spearman_delta_year": "task string, n_pairs bigint, rho_year double, rho_mean double",
    "doc_shift": "task string, doc_id bigint, n_overlap bigint, mean_shift double, sd double, se double, z double, flag_shift boolean",
    "assay_shift": "task string, assay_id bigint, n_overlap bigint, mean_shift double, sd double, se double, z double, flag_shift boolean",
    "audit_summary": "task string, n_meas bigint, n_docs bigint, n_assays bigint, year_min int, year_max int, n_mols bigint, n_ge2 bigint, n_ge3 bigint, frac_ge2 double, top_doc_share double",
    "audit_table": "task string, n_meas bigint, n_docs bigint, n_assays bigint, year_min int, year_max int, n_mols bigint, n_ge2 bigint, n_ge3 bigint, frac_ge2 double, top_doc_share double, sigma_nofilter double, n_rep_mols_nofilter bigint, sigma_diff3 double, n_rep_mols_diff3 bigint, sigma_diff2 double, n_rep_mols_diff2 bigint, sigma_pairs_dyear_le3 double, sigma_pairs_dyear_gt3 double, n_pairs_dyear_le3 bigint, n_pairs_dyear_gt3 bigint, frac_pairs_same_assay_id double, spearman_delta_dyear double, spearman_delta_mean double, n_docs_flag_shift bigint, n_docs_in_shift bigint, assays_per_doc_mean double, n_mols_multi_fullkey bigint, frac_mols_multi_fullkey double",
    "assays_per_doc": "task string, assays_per_doc double",
    "type_compare": "target string, n_both bigint, mean_diff double, sd_diff double, median_diff double, pearson double, spearman double, sigma_ic50 double, sigma_ki double",
    "multi_variant": "task string, n_multi bigint, frac_multi double, n_same bigint, delta_same double, n_other bigint, delta_other double",
    "exact_match_flags": "doc_id bigint, key_short string, exact_full boolean, exact_short boolean, exact_sources string",
    "exact_rate": "full_rate double, short_rate double, n bigint",
    "near_duplicates": "doc_id bigint, reg_id bigint, both bigint, similarity double",
    "max_similarity": "doc_id bigint, similarity double",
    "decontam_funnel": "source string, step_no int, step string, removed bigint, left bigint",
    "loss_totals": "step string, removed bigint",
    "loss_last": "source string, left bigint, step string",
    "loss_pivot": "source string, raw bigint, exact_full bigint, exact_short bigint, near bigint",
    "year_filter": "task string, n bigint, n_mols bigint",
    "model_cutoffs": "task string, model string, cutoff string, basis string, mols_after_year bigint, n_meas bigint, mols_after_steps12 bigint, overlap double, n_entities bigint",
    "model_overlap": "model string, overlap double, n_entities bigint",
    "source_overlap": "source string, n bigint, share double",
    "similarity_quantiles": "q05 double, q25 double, q50 double, q75 double, q90 double, q95 double, q99 double",
    "similarity_histogram": "bin int, n bigint",
    "threshold_sweep": "threshold double, removed bigint, share double",
    "containment_hits": "item_id bigint, doc_id bigint, both bigint, containment double",
    "registry_totals": "source string, n bigint, n_full bigint, n_short bigint",
    "registry_upsert": "source string, n bigint",
    "split_random": "task string, mol_id bigint, part string",
    "split_scaffold": "task string, mol_id bigint, part string",
    "split_temporal": "task string, mol_id bigint, part string",
    "predictions_long": "task string, split string, seed int, model string, mol_id bigint, y double, pred double, n_docs bigint, y_train_mean double",
    "predictions_completion": "task string, split string, seed int, model string, mol_id bigint, y double, pred double, n_docs bigint, y_train_mean double",
    "regression_metrics": "task string, split string, seed int, model string, n_test bigint, rmse double, mae double, r2 double, spearman double",
    "benchmark_rows": "task string, split string, seed int, model string, n_test bigint, rmse double, mae double, r2 double, spearman double, rmse_mean double, test_mean_inv_ndocs double, n_train bigint",
    "add_ceiling": "task string, split string, seed int, model string, n_test bigint, rmse double, mae double, r2 double, spearman double, rmse_mean double, test_mean_inv_ndocs double, n_train bigint, sigma double, var_y double, rmse_floor double, r2_max double, frac_ceiling double, frac_rmse double, frac_r2 double, frac_ceiling_true double, below_floor boolean, headroom double, low_headroom boolean",
    "per_task_fraction": "task string, split string, model string, rmse double, mae double, r2 double, spearman double, rmse_mean double, frac_ceiling double, frac_rmse double, n_test_rows bigint",
    "common_rows": "task string, split string, model string, n_common_rows bigint, frac_ceiling double",
    "leaderboard": "split string, model string, n_tasks bigint, rmse double, mae double, r2 double, spearman double, rmse_mean double, frac_ceiling double, frac_rmse double, place int",
    "paired_vs_baseline": "split string, model string, n_tasks bigint, mean_diff double, median_diff double, n_better bigint, mean_diff_rmse double",
    "attenuation": "task string, split string, seed int, model string, reliability double, r2_true double, rho_true double",
    "holm_bh": "task string, split string, seed int, model string, p double, p_holm double, p_bh double",
    "wilcoxon_tests": "split string, model string, n_tasks int, wilcoxon_p double, p_holm double, p_bh double, inside_noise boolean",
    "cluster_bootstrap_hash": "task string, split string, model string, frac_lo double, frac_med double, frac_hi double, rmse_lo double, rmse_med double, rmse_hi double, n_valid_draws bigint",
    "cluster_bootstrap_poisson": "task string, split string, model string, frac_lo double, frac_med double, frac_hi double, rmse_lo double, rmse_med double, rmse_hi double, n_valid_draws bigint",
    "aggregate_bootstrap_hash": "split string, model string, frac_lo double, frac_med double, frac_hi double",
    "aggregate_bootstrap_poisson": "split string, model string, frac_lo double, frac_med double, frac_hi double",
    "paired_bootstrap_hash": "task string, split string, model string, diff_lo double, diff_med double, diff_hi double, p_boot double, inside_noise boolean",
    "paired_bootstrap_poisson": "task string, split string, model string, diff_lo double, diff_med double, diff_hi double, p_boot double, inside_noise boolean",
    "slice_labels": "task string, split string, seed int, mol_id bigint, slice_type string, slice_value string",
    "slice_delta": "slice_type string, slice_value string, split string, model string, n_tasks bigint, n_mols bigint, delta_rmse double, delta_over_sigma double",
    "slice_intervals": "slice_type string, slice_value string, split string, model string, lo double, hi double, lo_over_sigma double, hi_over_sigma double, se double, mde_80 double, flag string",
    "cliff_pairs": "task string, a bigint, b bigint, similarity double, delta double",
    "cliff_mask": "task string, mol_id bigint, cliff boolean",
    "cliff_pair_metrics": "task string, split string, seed int, model string, n_pairs bigint, sign_acc double, rmse_delta double",
    "similarity_to_train": "mol_id bigint, task string, similarity double, sim_bin string",
    "comparison_artifacts": "task string, split string, seed int, n_train bigint, n_test bigint, mean_n_docs double, frac_ge2 double, rmse_floor double, floor_over_sd double, y_mean_train double, y_mean_test double, y_sd_train double, y_sd_test double, sd_ratio double, ks double, frac_outside double, maxsim_mean double, maxsim_median double, maxsim_q10 double, maxsim_q90 double, frac_maxsim_ge_08 double, frac_cliff_mols double, year_train double, year_test double",
    "ks_statistic": "task string, ks double",
    "parse_records": "target_id string, molecule_id string, structure string, standard_type string, value double, assay_id string, doc_id string, doc_year int",
    "embedding_lookup": "label int, n bigint, mean_square double",
    "ridge_gram": "i int, j int, v double",
    "ridge_predictions": "vec_id bigint, label int, pred double",
    "value_quantiles": "task string, q05 double, q50 double, q95 double",
    "cutoff_table": "model string, cutoff string, basis string, cut_year int",
    "model_summary": "model string, cutoff string, basis string, mols_after_year bigint, overlap double",
    "decontam_loss": "task string, step_no int, step string, mols_removed bigint, meas_removed bigint, mols_left bigint, meas_left bigint",
    "slice_table": "slice_type string, slice_value string, split string, model string, n_tasks bigint, n_mols bigint, delta_rmse double, delta_over_sigma double, lo double, hi double, lo_over_sigma double, hi_over_sigma double, se double, mde_80 double, flag string",
}
