"""Rule tables of anomalies and causal paths. Fixed values."""

#: Severity of an anomaly by (category, type, kind; an empty kind is any); medium where no row fits.
SEVERITY = [
    ("Change", "SpecModified", "ReplicaSet", "low"),
    ("State", "CrashLoopBackOff", "", "critical"),
    ("State", "ImagePullBackOff", "", "critical"),
    ("State", "PodFailed", "", "critical"),
    ("State", "NodeNotReady", "", "critical"),
    ("State", "SecretMissing", "", "critical"),
    ("State", "CertExpired", "", "critical"),
    ("State", "ServiceAccountMissing", "", "critical"),
    ("State", "HelmReleaseFailed", "", "critical"),
    ("State", "KustomizationFailed", "", "critical"),
    ("State", "PVCBindingFailed", "", "critical"),
    ("Event", "FailedScheduling", "", "critical"),
    ("Event", "FailedMount", "", "critical"),
    ("Event", "FailedAttachVolume", "", "critical"),
    ("Event", "FailedCreatePodSandBox", "", "critical"),
    ("Event", "FailedCreatePodContainer", "", "critical"),
    ("Event", "NetworkNotReady", "", "critical"),
    ("Event", "ImageNotFound", "", "critical"),
    ("Event", "RegistryAuthFailed", "", "critical"),
    ("State", "OOMKilled", "", "high"),
    ("State", "Deleted", "", "high"),
    ("State", "ErrorStatus", "", "high"),
    ("State", "NodeDiskPressure", "", "high"),
    ("State", "NodeMemoryPressure", "", "high"),
    ("State", "NodePIDPressure", "", "high"),
    ("State", "PodPending", "", "high"),
    ("State", "Evicted", "", "high"),
    ("State", "ImagePullError", "", "high"),
    ("State", "ErrImagePull", "", "high"),
    ("State", "ContainerCreateError", "", "high"),
    ("State", "InitContainerFailed", "", "high"),
    ("State", "RolloutStuck", "", "high"),
    ("Event", "BackOff", "", "high"),
    ("Event", "FailedCreate", "", "high"),
    ("Event", "RepeatedEvent", "", "high"),
    ("Event", "HighFrequencyEvent", "", "high"),
    ("Event", "Unhealthy", "", "high"),
    ("Event", "Evicted", "", "high"),
    ("Event", "InvalidConfigReference", "", "high"),
    ("Event", "RBACDenied", "", "high"),
    ("Event", "Forbidden", "", "high"),
    ("Event", "ImagePullTimeout", "", "high"),
    ("Event", "VolumeMountFailed", "", "high"),
    ("Event", "VolumeOutOfSpace", "", "high"),
    ("Event", "ReadOnlyFilesystem", "", "high"),
    ("Change", "ConfigMapModified", "", "high"),
    ("Change", "SecretModified", "", "high"),
    ("Change", "HelmReleaseUpdated", "", "high"),
    ("Change", "HelmUpgrade", "", "high"),
    ("Change", "HelmRollback", "", "medium"),
    ("Change", "ValuesChanged", "", "high"),
    ("Change", "KustomizationUpdated", "", "high"),
    ("Change", "ImageChanged", "", "high"),
    ("Change", "RoleModified", "", "high"),
    ("Change", "ClusterRoleModified", "", "high"),
    ("Change", "RoleBindingModified", "", "high"),
    ("Change", "ClusterRoleBindingModified", "", "high"),
    ("Change", "WorkloadSpecModified", "", "high"),
    ("Frequency", "HighRestartCount", "", "high"),
    ("Frequency", "FlappingState", "", "high"),
    ("State", "TerminatingStatus", "", "medium"),
    ("Event", "WarningEvent", "", "medium"),
    ("Event", "Killing", "", "medium"),
    ("Event", "Preempting", "", "medium"),
    ("Event", "ReplicaCreationFailure", "", "medium"),
    ("Change", "ReplicasChanged", "", "medium"),
    ("Change", "ResourceDeleted", "", "medium"),
    ("Change", "SpecModified", "", "medium"),
    ("Change", "EnvironmentChanged", "", "medium"),
    ("Change", "ResourceLimitsChanged", "", "medium"),
    ("Frequency", "RapidEvents", "", "medium"),
    ("Frequency", "ReconcileLoop", "", "medium"),
    ("Change", "ResourceCreated", "", "low"),
    ("Event", "NormalEvent", "", "low"),
]
#: Severity of an event by its reason; medium where none is listed.
REASON_SEVERITY = {
    "FailedScheduling": "critical",
    "FailedMount": "critical",
    "FailedAttachVolume": "critical",
    "FailedCreatePodSandBox": "critical",
    "FailedCreatePodContainer": "critical",
    "NetworkNotReady": "critical",
    "BackOff": "high",
    "CrashLoopBackOff": "high",
    "ImagePullBackOff": "high",
    "ErrImagePull": "high",
    "FailedCreate": "high",
    "OOMKilled": "high",
    "NodeNotReady": "high",
    "Unhealthy": "high",
    "FailedSync": "high",
    "FailedValidation": "high",
    "Evicted": "high",
    "InvalidConfigReference": "high",
    "RBACDenied": "high",
    "Forbidden": "high",
    "ImageNotFound": "critical",
    "RegistryAuthFailed": "critical",
    "ImagePullTimeout": "high",
    "VolumeMountFailed": "high",
    "VolumeOutOfSpace": "high",
    "ReadOnlyFilesystem": "high",
    "Killing": "medium",
    "Preempting": "medium",
    "FreeDiskSpaceFailed": "medium",
    "InsufficientMemory": "medium",
    "InsufficientCPU": "medium",
    "Pulled": "low",
    "Scheduled": "low",
    "Started": "low",
    "Created": "low",
    "ScalingReplicaSet": "low",
    "SuccessfulCreate": "low",
    "SuccessfulDelete": "low",
    "SuccessfulUpdate": "low",
}
BENIGN_REASONS = ["ScalingReplicaSet", "SuccessfulCreate", "SuccessfulDelete", "Scheduled", "Pulling", "Pulled", "Created", "Started", "NoPods", "ProvisioningSucceeded"]
POD_FAILURES = ["CrashLoopBackOff", "ImagePullBackOff", "ErrImagePull", "OOMKilled", "ContainerCreateError", "CreateContainerConfigError", "InvalidImageNameError", "PodPending", "Evicted", "ErrorStatus", "InitContainerFailed"]
CAUSE_INTRODUCING = ["ConfigChange", "SecretChange", "ConfigMapModified", "SecretModified", "HelmReleaseUpdated", "KustomizationUpdated", "WorkloadSpecModified", "ImageChanged", "EnvironmentChanged", "ResourceLimitsChanged", "RoleModified", "RoleBindingModified", "SpecModified", "ResourceDeleted", "NodeNotReady", "DiskPressure", "NodeDiskPressure", "NodeMemoryPressure", "NodePIDPressure", "NodeNetworkPressure", "Evicted", "SecretMissing", "InvalidConfigReference", "CertExpired", "ServiceAccountMissing", "RBACDenied", "ClusterRoleModified", "ClusterRoleBindingModified", "HelmUpgrade", "HelmRollback", "ValuesChanged", "HelmReleaseFailed", "KustomizationFailed", "ImageNotFound", "RegistryAuthFailed", "ImagePullTimeout", "PVCBindingFailed", "VolumeMountFailed", "VolumeOutOfSpace", "ReadOnlyFilesystem"]
DERIVED = ["CrashLoopBackOff", "OOMKilled", "PodFailed", "PodPending", "ErrorStatus", "TerminatingStatus", "CreateContainerErr", "InitContainerFailed", "RolloutStuck", "ReplicaCreationFailure"]
INTERMEDIATE = ["ResourceCreated"]
DEFINITIVE = ["ResourceDeleted", "Deleted", "TerminatingStatus", "SecretMissing", "ConfigMapMissing", "ServiceAccountMissing", "NodeNotReady", "DiskPressure", "NodeDiskPressure", "NodeMemoryPressure", "NodePIDPressure", "NodeNetworkPressure", "CertExpired", "InvalidConfigReference"]
INTENT_KINDS = ["HelmRelease", "Kustomization", "Application", "Node", "ConfigMap", "Secret", "PersistentVolume", "PersistentVolumeClaim", "ClusterRole", "Role", "ClusterRoleBinding", "RoleBinding", "ServiceAccount"]
GITOPS_KINDS = ["HelmRelease", "Kustomization", "Application"]
RECONCILED_TYPES = ["ImageChanged", "SpecModified", "ResourceCreated", "EnvironmentChanged", "ResourceLimitsChanged", "WorkloadSpecModified"]
RECONCILED_KINDS = ["Deployment", "StatefulSet", "DaemonSet", "Job", "CronJob", "ConfigMap", "Secret", "Service", "Ingress"]
CAUSE_EDGES = ["MANAGES", "TRIGGERED_BY", "REFERENCES_SPEC", "USES_SERVICE_ACCOUNT", "GRANTS_TO", "BINDS_ROLE"]
